import pytest

from cairn.llm import residue as r

CASES = {
    "open slot": ["Dear {{ name }}, your report is ready.", "We saw [your title here] that it works.", "Release %VERSION% of <module path goes here>", "Owner: ____", "It took «author» long.", "name: ${title}"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do.", "Your content here. Your content here. Your content here.", "asdf jkl asdf 77", "A real sentence stands here.\n\nVitae urna massa lorem augue dolor velit sit amet.", "TBD\n\n- window"],
    "unfilled form": ["<!-- describe -->\n## What changes?\n- [ ] added tests\n_none yet_\n", "## Tests\nFixes #(ticket)\n- [ ] docs\n"],
    "error page": ["Page not found. We couldn't find index. #616", "502 Bad Gateway\n\nThe requested URL /a/b was not found or could not be served.\n\nserver at docs.example.invalid port 443", "You need to enable JavaScript to run rack.\n\nMenu | Search | Sign in", "Fehler 410: Seite nicht gefunden.", "Veuillez activer JavaScript pour afficher easel."],
}
REAL = [
    None, "", "  \n ", "In templates, write `{{ name }}` to print a value; the renderer escapes it.", 'Opening it shows "502 Bad Gateway" on slow links. I expected the cached page.', "Fixtures use a lorem ipsum paragraph of 41 words so that widths can be compared.",
    "```html\n<p>{{ title }}</p>\n```\nThe page is drawn from this.", "La page affiche « page introuvable » quand `load` échoue.", "Fix typo in cache.", "## What changes?\nThe sweep keeps old rows.\n- [ ] docs\n", "Name: Index\nOwner: the team\nNotes: none so far",
]


def test_verdicts(spark):
    rows = [(i, t) for i, t in enumerate([t for ts in CASES.values() for t in ts] + REAL)]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows] + [(0, rows[0][1], "w")], "doc_id long, text string, why string")
    got = {x["id"]: x["why"] for x in r.residue(df).collect()}
    want = {}
    i = 0
    for why, texts in CASES.items():
        for _ in texts:
            want[i] = why
            i += 1
    assert got == want


def test_alignment_learns_a_template(spark):
    pages = [f"This viewer needs scripts before it can show {x}." for x in ("atlas", "mill", "kiln", "the rack")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pages + ["The extractor reads scripts in order."])], "doc_id long, text string")
    assert {x["id"] for x in r.residue(df).collect()} == {0, 1, 2, 3}


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert r.residue(df).count() == 0
    long = spark.createDataFrame([(1, "A plain sentence of text. " * 20_000), (2, "A plain one. " * 20_000 + "{{ name }}")], "doc_id long, text string")
    assert {x["id"] for x in r.residue(long).collect()} == {2} or {x["id"]: x["why"] for x in r.residue(long).collect()}[2] == "open slot"


@pytest.mark.parametrize("phrase, yes", [("sample text 72", True), ("content coming soon content coming soon", True), ("test the sample", False), ("asdf", True), ("to be written to be written 17", True), ("noch zu schreiben noch zu schreiben", True), ("we saw that we saw the tree", False), ("12 34", False), ("", False), ("very very", False)])
def test_stand_ins(phrase, yes):
    assert r.stands_in(phrase) is yes


def test_slots_in_forms_that_are_not_listed(spark):
    texts = [f"Dear $customer_{x}$, your report is ready." for x in ("name", "city", "mail")] + ["Dear Ann, your report is ready.", "The sweep keeps $PROJECT_NAME$ old rows.", "Dear **reader**, the price is $value$ or so.", "Write `$customer_name$` for the name."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["id"]: x["why"] for x in r.residue(df).collect()} == dict.fromkeys([0, 1, 2, 4], "open slot")


def test_long_texts_take_part_and_copies_count(spark):
    echo = ["пример текста здесь. " * 40 + tail for tail in ("", "пример текста здесь.")]
    parts = " ".join("Try again later. Something went wrong. Sign in again." for _ in range(10))
    pages = [f"{parts} The {x} gateway keeps no session for you." for x in ("atlas", "mill", "kiln")]
    form = ["Reviewer: \nDeadline: \n"] * 3
    real = ["The sweep keeps old rows and reports each of them. " + "It reads the index in path order. " * 10]
    df = spark.createDataFrame(list(enumerate(echo + pages + form + real)), "doc_id long, text string")
    assert {x["id"]: x["why"] for x in r.residue(df).collect()} == dict.fromkeys([0, 1], "filler") | dict.fromkeys([2, 3, 4], "error page") | dict.fromkeys([5, 6, 7], "unfilled form")


def test_numbers_do_not_part_what_is_said_again(spark):
    texts = ["noch offen\nnoch offen\nnoch offen\nnoch offen 64", "noch offen\n" * 8 + "noch offen 15", "noch offen 29", "Noch offen ist die Frage nach dem Index."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["id"]: x["why"] for x in r.residue(df).collect()} == dict.fromkeys([0, 1, 2], "filler")
