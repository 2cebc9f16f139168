"""The bundled grammars of ten languages and the words and marks that become their tokens.

The grammars take a little more than the languages do (types and names aren't told apart, for instance), and read what a
file of each language may hold. BIN stands for any other binary operator, PRE for one that only stands before an operand,
SIGN for one that may do either. NL ends a line, IND and DED open and close an indented block.
"""

import re

# The languages' key words and operators, as their public grammars give them.

PYTHON = r"""
file: ( NL | stmt )* EOF
stmt: simple | compound | '@' expr NL+ ( decorated | '@' expr NL+ )+
decorated: 'def' fdef | 'class' cdef | 'async' 'def' fdef
simple: small ( ';' [ small ] )* NL
small: 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ expr [ 'from' expr ] ] | 'global' NAME ( ',' NAME )* | 'nonlocal' NAME ( ',' NAME )*
  | 'del' exprs | 'assert' expr [ ',' expr ] | 'import' dotted_as ( ',' dotted_as )* | 'from' ( ( '.' | '...' )+ [ dotted ] | dotted ) 'import' ( STAR | '(' names ')' | name_as ( ',' name_as )* )
  | exprs [ ':' expr ] ( ASSIGN ( 'yield' [ yrest ] | exprs ) )* | 'yield' [ yrest ]
yrest: 'from' expr | exprs
names: name_as ( ',' [ name_as ] )*
name_as: NAME [ 'as' NAME ]
dotted: NAME ( '.' NAME )*
dotted_as: dotted [ 'as' NAME ]
compound: 'if' test suite ( 'elif' test suite )* [ 'else' suite0 ] | 'while' test suite [ 'else' suite0 ] | 'for' exprs_in 'in' exprs suite [ 'else' suite0 ]
  | 'try' suite0 ( ( 'except' [ STAR ] [ exprs [ 'as' NAME ] ] suite )+ [ 'else' suite0 ] [ 'finally' suite0 ] | 'finally' suite0 ) | 'with' withs suite | 'def' fdef | 'class' cdef
  | 'async' ( 'def' fdef | 'with' withs suite | 'for' exprs_in 'in' exprs suite [ 'else' suite0 ] )
  | 'match' exprs ':' NL+ IND ( 'case' casep ( ',' [ casep ] )* [ 'if' expr ] suite | NL )+ DED
casep: [ STAR ] ors [ 'as' NAME ]
test: expr
withs: expr [ 'as' expr ] ( ',' expr [ 'as' expr ] )*
fdef: NAME '(' [ params ] ')' [ '->' expr ] suite
cdef: NAME [ '(' [ args ] ')' ] suite
params: param ( ',' [ param ] )*
param: ( STAR [ NAME [ ':' expr ] ] | '**' NAME [ ':' expr ] | '/' | NAME [ ':' expr ] ) [ ASSIGN expr ]
suite: ':' ( simple | NL+ IND ( stmt | NL )+ DED )
suite0: suite
exprs: star ( ',' [ star ] )*
star: [ STAR ] expr
expr: 'lambda' [ lparams ] ':' expr | ors [ 'if' ors 'else' expr ] [ ':=' expr ]
lparams: lparam ( ',' [ lparam ] )*
lparam: ( STAR [ NAME ] | '**' NAME | '/' | NAME ) [ ASSIGN expr ]
ors: operand ( bin operand )*
bin: BIN | SIGN | STAR | '**' | '/' | 'and' | 'or' | 'is' [ 'not' ] | 'in' | 'not' 'in'
operand: ( 'not' | PRE | SIGN | 'await' )* atom ( '.' NAME | '(' [ args ] ')' | '[' subs ']' )*
atom: NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' [ inner | 'yield' [ yrest ] ] ')' | '[' [ inner ] ']' | '{' [ entries ] '}'
inner: star ( comp | ( ',' [ star ] )* )
comp: [ 'async' ] 'for' exprs_in 'in' ors ( 'if' ors | [ 'async' ] 'for' exprs_in 'in' ors )*
exprs_in: tgt ( ',' [ tgt ] )*
tgt: [ STAR ] atom ( '.' NAME | '(' [ args ] ')' | '[' subs ']' )*
entries: entry ( comp | ( ',' [ entry ] )* )
entry: '**' expr | star [ ':' expr ]
args: arg ( ',' [ arg ] )*
arg: STAR expr | '**' expr | expr [ ASSIGN expr | comp ]
subs: sub ( ',' [ sub ] )*
sub: ':' [ expr ] [ ':' [ expr ] ] | star [ ':' [ expr ] [ ':' [ expr ] ] ]
"""

GDSCRIPT = r"""
file: ( NL | stmt )* EOF
stmt: compound | simple
simple: small ( ';' [ small ] )* NL
small: 'pass' | 'break' | 'continue' | 'breakpoint' | 'return' [ expr ] | 'extends' ( STR | dotted ) | 'class_name' NAME [ ',' STR ] [ 'extends' dotted ] | 'signal' NAME [ '(' [ params ] ')' ] | 'tool'
  | 'const' NAME [ ':' [ type ] ] ASSIGN expr | 'enum' [ NAME ] '{' [ NAME [ ASSIGN expr ] ( ',' [ NAME [ ASSIGN expr ] ] )* ] '}' | expr [ ASSIGN expr ] | 'assert' '(' args ')'
compound: 'if' expr suite ( 'elif' expr suite )* [ 'else' suite ] | 'while' expr suite | 'for' NAME [ ':' type ] 'in' expr suite | 'match' expr suite_m | fun | 'class' NAME [ 'extends' dotted ] suite | var | '@' NAME [ '(' [ args ] ')' ] NL*
fun: [ 'static' ] 'func' NAME '(' [ params ] ')' [ '->' type ] suite
var: ( 'var' | 'onready' 'var' | 'export' [ '(' args ')' ] [ 'onready' ] 'var' ) NAME [ ':' [ type ] ] [ ASSIGN expr ] [ 'setget' [ NAME ] [ ',' NAME ] ] ( NL | ':' NL+ IND ( acc | NL )+ DED )
acc: NAME [ '(' NAME ')' ] suite
suite: ':' ( simple | NL+ IND ( stmt | NL )+ DED )
suite_m: ':' NL+ IND ( expr ( ',' expr )* suite | 'var' NAME suite | NL )+ DED
params: param ( ',' [ param ] )*
param: NAME [ ':' [ type ] ] [ ASSIGN expr ]
type: dotted [ '[' type ( ',' type )* ']' ]
dotted: NAME ( '.' NAME )*
expr: ors [ 'if' ors 'else' expr ]
ors: operand ( bin operand )*
bin: BIN | SIGN | STAR | '/' | '**' | 'and' | 'or' | 'in' | 'is' [ 'not' ] | 'as' | 'not' 'in'
operand: ( 'not' | PRE | SIGN | 'await' | 'yield' )* atom ( '.' NAME | '(' [ args ] ')' | '[' expr ']' )*
atom: NAME | NUM | STR | PRE2 ( STR | NAME ( '/' NAME )* ) | 'null' | 'true' | 'false' | 'self' | '(' expr ')' | '[' [ args ] ']' | '{' [ entry ( ',' [ entry ] )* ] '}' | 'func' [ NAME ] '(' [ params ] ')' [ '->' type ] suite
args: expr ( ',' [ expr ] )*
entry: expr ( ':' | ASSIGN ) expr
"""

RUBY = r"""
file: ( NL | stmts )* EOF
stmts: stmt ( NL | ';' )+
body: stmt_or_nl ( stmt_or_nl )*
stmt_or_nl: NL | ';' | stmt
stmt: line ( 'if_mod' line | 'unless_mod' line | 'while_mod' line | 'until_mod' line | 'rescue_mod' line )*
line: 'not' line | phrase ( ( 'and' | 'or' ) phrase )*
phrase: def | 'class' ( '<<' operand | cname [ '<' phrase ] ) seps [ body ] 'end' | 'module' cname seps [ body ] 'end' | 'alias' sym sym | 'undef' sym | values [ ASSIGN values ( ASSIGN values )* ]
cname: CONST ( '::' CONST )* | '::' CONST
sym: NAME | CONST | SYM | OPNAME
seps: NL | ';'
def: 'def' ( NAME | KEY | CONST | 'self' | OPNAME ) [ '.' ( NAME | CONST ) ] [ ASSIGN ] ( '(' [ params ] ')' | [ params ] ) ( ASSIGN phrase | ( NL | ';' ) [ body ] [ rescues ] 'end' | [ rescues ] 'end' )
rescues: 'ensure' [ body ] | 'rescue' [ values ] [ '=>' NAME ] ( 'then' | NL | ';' ) [ body ] [ rescues ] | 'else' [ body ] [ rescues ]
params: param ( ',' param )*
param: ( STAR | '**' | '&' ) [ NAME ] | NAME [ ASSIGN expr ] | LABEL [ expr ] | '(' params ')'
values: value ( ',' value )*
value: STAR expr | '**' expr | '&' expr | expr
expr: ors [ '?' expr ':' expr ]
ors: operand ( bin operand )* [ RANGE [ operand ( bin operand )* ] ]
bin: BIN | SIGN | STAR | '**' | '&' | '|' | '<' | '<<' | '/' | '=>'
operand: ( PRE | SIGN | 'defined' | '->' )* atom ( '.' ( NAME | CONST | KEY | '(' [ args ] ')' ) | '::' ( NAME | CONST ) | '(' [ args ] ')' | '[' [ args ] ']' | block )* [ command ]
command: CMD args
block: '{' [ bars ] [ bodyb ] '}' | 'do' [ bars ] [ body ] [ rescues ] 'end'
bodyb: stmt_or_nl ( stmt_or_nl )*
bars: '|' [ params ] '|'
atom: NAME | CONST | IVAR | NUM | STR+ | SYM | REGEX | 'nil' | 'true' | 'false' | 'self' | 'super' | 'yield' | '__FILE__' | '::' CONST | '(' [ body ] ')' | '[' [ args ] ']' | HASH [ args ] '}'
  | 'if' line ( 'then' | seps ) [ body ] ( 'elsif' line ( 'then' | seps ) [ body ] )* [ 'else' [ body ] ] 'end' | 'unless' line ( 'then' | seps ) [ body ] [ 'else' [ body ] ] 'end' | 'while' line ( 'do' | seps ) [ body ] 'end'
  | 'until' line ( 'do' | seps ) [ body ] 'end' | 'for' NAME ( ',' NAME )* 'in' line ( 'do' | seps ) [ body ] 'end' | 'case' [ line ] NL* ( ( 'when' | 'in' ) values ( 'then' | seps ) [ body ] )+ [ 'else' [ body ] ] 'end'
  | 'begin' [ body ] [ rescues ] 'end' | ( 'return' | 'break' | 'next' ) [ values ] | 'redo' | 'retry'
args: arg ( ',' [ arg ] )*
arg: NL | LABEL [ expr ] | value [ ASSIGN expr | ':' expr ]
"""

GO = r"""
file: ';'* ( EOF | 'package' NAME ';'+ ( 'import' ( imp | '(' ( imp ';' | ';' )* ')' ) ( ';' )+ )* ( top ( ';' )+ )* EOF )
imp: [ NAME | '.' ] STR
top: 'func' ( NAME [ tparams ] | '(' [ params ] ')' NAME ) sig [ block ] | 'type' ( tspec | '(' ( tspec ';' | ';' )* ')' ) | 'var' ( vspec | '(' ( vspec ';' | ';' )* ')' ) | 'const' ( vspec | '(' ( vspec ';' | ';' )* ')' )
tspec: NAME [ ASSIGN ] ( type | '[' [ NAME ( ( ',' NAME )* type ( ',' NAME+ type )* ']' | ']' ) | ']' | NUM ']' ] type )
tparams: '[' NAME ( ',' NAME )* type ( ',' NAME ( ',' NAME )* type )* ']'
vspec: NAME ( ',' NAME )* ( type [ ASSIGN exprs ] | ASSIGN exprs )*
sig: '(' [ params ] ')' [ rtype ]
rtype: '(' [ params ] ')' | type
params: param ( ',' [ param ] )*
param: '...' type | type [ [ '...' ] type ]
type: STAR type | '[' [ '...' | expr ] ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type | 'func' sig | 'struct' '{' ( field ';' | ';' )* [ field ] '}' | 'interface' '{' ( meth ';' | ';' )* [ meth ] '}' | qual | '(' type ')'
qual: NAME [ '.' NAME ] [ '[' type ( ',' type )* ']' ]
field: ( STAR qual | NAME ( ',' NAME )* [ '.' NAME | type ] ) [ STR ]
meth: [ '~' ] NAME [ '.' NAME | sig ] ( '|' [ '~' ] type )*
block: '{' [ stmts ] '}'
stmts: sm ( sm )*
sm: ';' | stmt
stmt: block | 'return' [ exprs ] | 'if' head block [ 'else' ( 'if' head block ( 'else' ( 'if' head block | block ) )* | block ) ] | 'for' [ fhead ] block | 'switch' [ shead ] '{' ( ( 'case' exprs | 'default' ) ':' [ stmts ] | ';' )* '}'
  | 'select' '{' ( ( 'case' simple | 'default' ) ':' [ stmts ] | ';' )* '}' | 'defer' expr | 'go' expr | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | 'var' ( vspec | '(' ( vspec ';' | ';' )* ')' ) | 'const' ( vspec | '(' ( vspec ';' | ';' )* ')' ) | 'type' tspec | simple
head: simple_h [ ';' simple_h ] | ';' simple_h
shead: simple_h [ ';' [ simple_h ] ] | ';' [ simple_h ]
fhead: 'range' expr_h | simple_h [ ';' [ simple_h ] ';' [ simple_h ] ] | ';' [ simple_h ] ';' [ simple_h ]
simple_h: exprs_h [ ( ASSIGN | ':=' ) ( 'range' expr_h | exprs_h ) | '++' | '--' ]
exprs_h: expr_h ( ',' expr_h )*
expr_h: operand_h ( bin operand_h )*
operand_h: ( PRE | SIGN | STAR | '<-' | '&' )* atom ( '.' ( NAME | '(' ( 'type' | type ) ')' ) | '(' [ args ] ')' | '[' slice ']' )*
simple: exprs [ ( ASSIGN | ':=' ) exprs | '++' | '--' | '<-' expr | ':' ]
exprs: expr ( ',' expr )*
expr: operand ( bin operand )*
bin: BIN | SIGN | STAR | '&' | '|' | '/'
operand: ( PRE | SIGN | STAR | '<-' | '&' )* atom ( '.' ( NAME | '(' ( 'type' | type ) ')' ) | '(' [ args ] ')' | '[' slice ']' | lit )*
atom: NAME | NUM | STR | '(' ( expr | type ) ')' | 'func' sig [ block ] | '[' [ '...' | expr ] ']' type [ lit ] | 'map' '[' type ']' type [ lit ] | 'struct' '{' ( field ';' )* '}' [ lit ] | 'interface' '{' '}' | 'chan' type
lit: '{' [ el ( ',' [ el ] )* ] '}'
el: ( lit | expr ) [ ':' ( lit | expr ) ]
args: arg ( ',' [ arg ] )*
arg: expr [ '...' ]
slice: ':' [ expr ] [ ':' expr ] | expr ( ':' [ expr ] [ ':' expr ] | ( ',' type )* )
"""

RUST = r"""
file: ( item )* EOF
attr: '#' [ '!' ] '[' ( tok )* ']'
tok: NAME | NUM | STR | ASSIGN | ',' | '(' ( tok )* ')' | '[' ( tok )* ']' | '{' ( tok )* '}' | BIN | SIGN | '::' | ':' | ';' | '!' | '.' | '&' | '<' | '>' | STAR | '=>' | '#' | '$' | '|' | LIFE | '->' | '?' | '@' | '..' | '..=' | '||' | PRE | 'self' | 'Self' | 'super' | 'crate' | 'mut' | 'as' | 'if' | 'else' | 'match' | 'let' | 'fn' | 'move' | 'ref' | 'in' | 'for' | 'while' | 'loop' | 'return' | 'break' | 'continue' | 'pub' | 'use' | 'mod' | 'struct' | 'enum' | 'impl' | 'trait' | 'type' | 'const' | 'static' | 'unsafe' | 'async' | 'await' | 'dyn' | 'extern' | 'where'
item: attr | ';' | [ 'pub' [ '(' ( tok )+ ')' ] ] decl
decl: 'use' usetree ';' | 'mod' NAME ( ';' | '{' ( item )* '}' ) | ( 'const' | 'static' ) ( 'mut' NAME ':' type ASSIGN expr ';' | NAME ':' type [ ASSIGN expr ] ';' | fn ) | fn | 'unsafe' ( fn | impl | trait ) | 'async' [ 'unsafe' ] fn | 'extern' [ STR ] ( fn | 'crate' NAME ';' | '{' ( item )* '}' ) | 'struct' NAME [ gen ] sbody | 'enum' NAME [ gen ] [ where ] '{' [ variant ( ',' [ variant ] )* ] '}'
  | 'type' NAME [ gen ] [ ':' bounds ] [ ASSIGN type ] ';' | impl | trait | NAME '!' [ NAME ] ( '{' ( tok )* '}' | '(' ( tok )* ')' ';' )
sbody: ';' | [ where ] '{' [ sfield ( ',' [ sfield ] )* ] '}' | '(' [ tfield ( ',' [ tfield ] )* ] ')' [ where ] ';'
sfield: ( attr )* [ 'pub' [ '(' ( tok )+ ')' ] ] NAME ':' type
tfield: ( attr )* [ 'pub' [ '(' ( tok )+ ')' ] ] type
variant: ( attr )* NAME [ '(' [ tfield ( ',' [ tfield ] )* ] ')' | '{' [ sfield ( ',' [ sfield ] )* ] '}' ] [ ASSIGN expr ]
impl: 'impl' [ gen ] [ '!' ] type [ 'for' type ] [ where ] '{' ( item )* '}'
trait: 'trait' NAME [ gen ] [ ':' bounds ] [ where ] '{' ( item )* '}'
fn: 'fn' NAME [ gen ] '(' [ fparam ( ',' [ fparam ] )* ] ')' [ '->' type ] [ where ] ( ';' | block )
fparam: ( attr )* pat [ ':' type ]
gen: '<' [ gparam ( ',' [ gparam ] )* ] '>'
gparam: LIFE [ ':' LIFE ] | [ 'const' ] NAME [ ':' bounds ] [ ASSIGN type ]
where: 'where' ( type | LIFE ) ':' bounds ( ',' [ ( type | LIFE ) ':' bounds ] )*
bounds: bound ( SIGN bound )*
bound: LIFE | [ '?' ] type
usetree: [ '::' ] ( STAR | '{' [ usetree ( ',' [ usetree ] )* ] '}' | seg ( '::' useend )* [ 'as' NAME ] )
useend: STAR | '{' [ usetree ( ',' [ usetree ] )* ] '}' | seg
seg: NAME | 'self' | 'super' | 'crate' | 'Self'
type: '&' [ LIFE ] [ 'mut' ] type | STAR ( 'const' | 'mut' ) type | '(' [ type ( ',' [ type ] )* ] ')' | '[' type [ ';' expr ] ']' | '!' | ( 'dyn' | 'impl' ) bounds | [ 'unsafe' ] 'fn' '(' [ type ( ',' type )* ] ')' [ '->' type ] | path | '<' type [ 'as' type ] '>' '::' path
path: [ '::' ] seg [ targs ] ( '::' ( seg | '<' [ ta ( ',' [ ta ] )* ] '>' ) [ targs ] )*
targs: '<' [ ta ( ',' [ ta ] )* ] '>' | '(' [ type ( ',' type )* ] ')' [ '->' type ]
ta: LIFE | NUM | type [ ASSIGN type ]
block: '{' [ inner ] '}'
inner: st ( st )*
st: ';' | attr | 'let' pat [ ':' type ] [ ASSIGN expr [ 'else' block ] ] ';' | 'use' usetree ';' | fn | 'const' NAME ':' type ASSIGN expr ';' | 'struct' NAME [ gen ] sbody | ctl [ '.' chain ] | expr [ ';' ]
chain: chained ( bin operand )*
chained: ( NAME | NUM | 'await' ) ( '.' ( NAME | NUM | 'await' ) | '(' [ args ] ')' | '[' expr ']' | '?' )*
ctl: 'if' cond block ( 'else' ( 'if' cond block | block ) )* | 'match' expr_h '{' [ arm ( arm )* ] '}' | [ LIFE ':' ] loop | block | 'unsafe' block
loop: 'loop' block | 'while' cond block | 'for' pat 'in' expr_h block
cond: condp ( BIN condp )*
condp: 'let' pat ASSIGN expr_h | expr_h
arm: ( attr )* pat [ 'if' expr_h ] '=>' ( block [ ',' ] | expr [ ',' ] )
pat: [ '|' ] pat1 ( '|' pat1 )*
pat1: '&' [ 'mut' ] pat1 | 'ref' [ 'mut' ] NAME | 'mut' ( NAME | 'self' ) [ '@' pat1 ] | '(' [ pat ( ',' [ pat ] )* ] ')' | '[' [ pat ( ',' [ pat ] )* ] ']' | '..' | [ SIGN ] NUM [ ( '..=' | '..' ) [ [ SIGN ] NUM ] ] | STR [ ( '..=' | '..' ) STR ] | patpath
patpath: path_e [ '(' [ pat ( ',' [ pat ] )* ] ')' | '{' [ fpat ( ',' [ fpat ] )* ] '}' | '@' pat1 | '..=' path_e ]
fpat: '..' | [ 'ref' ] [ 'mut' ] NAME [ ':' pat ]
path_e: [ '::' ] seg ( '::' ( seg | '<' [ ta ( ',' [ ta ] )* ] '>' ) )*
expr: operand ( bin operand )* [ ASSIGN expr ] | '..' [ operand ( bin operand )* ] | '..=' operand | 'return' [ expr ] | 'break' [ LIFE ] [ expr ] | 'continue' [ LIFE ] | clos
clos: [ 'move' ] ( '||' | '|' [ cpar ( ',' cpar )* ] '|' ) [ '->' type ] expr
cpar: pat1 [ ':' type ]
bin: BIN | SIGN | STAR | '&' | '|' | '||' | '<' [ '<' ] [ ASSIGN ] | '>' [ '>' ] [ ASSIGN ] | '..' | '..='
operand: ( PRE | SIGN | STAR | '!' | '&' [ 'mut' ] )* atom post
post: POST
expr_h: operand_h ( bin operand_h )*
operand_h: ( PRE | SIGN | STAR | '!' | '&' [ 'mut' ] )* atom_h post
atom_h: NUM | STR | path_e [ '!' ( '(' ( tok )* ')' | '[' ( tok )* ']' ) ] | '(' [ expr ( ',' [ expr ] )* ] ')' | '[' [ expr ( ';' expr | ( ',' [ expr ] )* ) ] ']' | clos | 'match' expr_h '{' ( arm )* '}'
atom: NUM | STR | path_e [ '!' ( '(' ( tok )* ')' | '[' ( tok )* ']' | '{' ( tok )* '}' ) | '{' [ finit ( ',' [ finit ] )* ] '}' ] | '(' [ expr ( ',' [ expr ] )* ] ')' | '[' [ expr ( ';' expr | ( ',' [ expr ] )* ) ] ']' | ctl | clos | 'async' [ 'move' ] block
finit: '..' expr | NAME [ ':' expr ]
args: expr ( ',' [ expr ] )*
"""
# what may follow an operand of Rust, written into the two rules that use it
RUST = (
    RUST.replace("post: POST\n", "")
    .replace(" post\n", " ( '.' ( NAME [ '::' targs ] | NUM | 'await' ) | '(' [ args ] ')' | '[' expr ']' | '?' | 'as' type )*\n")
)

JAVA = r"""
file: ( ';' | 'package' dotted ';' | 'import' [ MOD ] NAME ( '.' ( NAME | STAR ) )* ';' | type_decl )* EOF
dotted: NAME ( '.' NAME )*
mods: ( MOD | ann )+
ann: '@' dotted [ '(' [ anarg ( ',' anarg )* ] ')' ]
anarg: expr | '{' [ expr ( ',' [ expr ] )* ] '}' | ann
type_decl: [ mods ] tdecl
tdecl: 'class' NAME [ gen ] [ 'extends' type ] [ 'implements' types ] body | 'interface' NAME [ gen ] [ 'extends' types ] body | '@interface' NAME body | 'enum' NAME [ 'implements' types ] '{' [ enumc ( ',' [ enumc ] )* ] [ ';' ( member )* ] '}' | 'record' NAME [ gen ] '(' [ params ] ')' [ 'implements' types ] body
enumc: ( ann )* NAME [ '(' [ args ] ')' ] [ body ]
types: type ( ',' type )*
gen: '<' tparam ( ',' tparam )* '>'
tparam: NAME [ 'extends' type ( '&' type )* ]
body: '{' ( member )* '}'
member: ';' | block | mods mrest | mrest
mrest: tdecl | gen type mname | block | type ( '(' [ params ] ')' [ 'throws' types ] ( block | ';' ) | mname )
mname: NAME ( '(' [ params ] ')' ( '[' ']' )* [ 'throws' types ] ( block | ';' | 'default' expr ';' ) | vars ';' )
vars: ( '[' ']' )* [ ASSIGN init ] ( ',' NAME ( '[' ']' )* [ ASSIGN init ] )*
init: '{' [ init ( ',' [ init ] )* ] '}' | expr
params: param ( ',' param )*
param: [ mods ] type [ '...' ] NAME ( '[' ']' )*
type: ( NAME | PRIM ) [ targs ] ( '.' NAME [ targs ] )* ( '[' ']' )*
targs: '<' [ ta ( ',' ta )* ] '>'
ta: '?' [ ( 'extends' | 'super' ) type ] | type
block: '{' ( stmt )* '}'
stmt: ';' | block | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' ( ';' frest | local ( ':' expr ')' stmt | ';' frest ) ) | 'switch' '(' expr ')' '{' ( ( 'case' carg ( ',' carg )* | 'default' ) ( ':' | '->' ) | stmt )* '}'
  | 'try' [ '(' local ( ';' [ local ] )* ')' ] block ( 'catch' '(' [ mods ] type ( '|' type )* NAME ')' block )* [ 'finally' block ] | 'return' [ expr ] ';' | 'throw' expr ';' | 'break' [ NAME ] ';' | 'continue' [ NAME ] ';' | 'synchronized' '(' expr ')' block | 'assert' expr [ ':' expr ] ';'
  | mods ( tdecl | local ';' ) | tdecl | 'yield' expr ';' | local ( ';' | ':' stmt )
frest: [ expr ] ';' [ expr ( ',' expr )* ] ')' stmt
local: [ 'final' ] expr ( ',' expr )* [ NAME ( '[' ']' )* [ ASSIGN init ] ( ',' NAME ( '[' ']' )* [ ASSIGN init ] )* ]
carg: operand ( bin operand )* [ NAME ]
expr: cond [ ASSIGN ( expr | '{' [ init ( ',' [ init ] )* ] '}' ) | '->' ( block | expr ) ]
cond: ors [ '?' expr ':' expr ]
ors: operand ( bin operand )*
bin: BIN | SIGN | STAR | '&' | '|' | '<' | '>' [ '>' [ '>' ] ] | 'instanceof' [ 'final' ]
operand: ( PRE | SIGN | '++' | '--' )* atom ( '.' ( NAME | 'class' | 'this' | 'super' | 'new' type '(' [ args ] ')' | targs NAME ) | '(' [ args ] ')' | '[' [ expr ] ']' | '::' ( NAME | 'new' ) | '++' | '--' )*
atom: NAME | GENERIC | PRIM | NUM | STR | 'null' | 'true' | 'false' | 'this' | 'super' | '(' [ lexpr ( ',' lexpr )* ] ')' [ operand ] | 'new' type ( '(' [ args ] ')' [ body ] | '[' [ expr ] ']' ( '[' [ expr ] ']' )* [ init ] | init ) | 'switch' '(' expr ')' '{' ( ( 'case' carg ( ',' carg )* | 'default' ) ( ':' | '->' ) | stmt )* '}'
lexpr: [ 'final' ] expr [ NAME ]
args: arg ( ',' arg )*
arg: expr
"""

C_SHARP = r"""
file: ( ';' | using | top )* EOF
using: [ 'global' ] 'using' [ 'static' ] NAME [ ASSIGN type ';' | ( '.' NAME )* [ targs ] ';' ]
top: 'namespace' dotted ( ';' | '{' ( ';' | using | top )* '}' ) | attr | mods_decl
dotted: NAME ( '.' NAME )*
attr: '[' atr [ ':' atr ] ( ',' [ atr ] )* ']'
atr: dotted [ '(' [ args ] ')' ]
mods_decl: ( MOD )* tdecl
tdecl: ( 'class' | 'struct' | 'interface' | 'record' [ 'class' | 'struct' ] ) NAME [ gen ] [ '(' [ params ] ')' ] [ ':' type [ '(' [ args ] ')' ] ( ',' type )* ] ( where )* ( body [ ';' ] | ';' ) | 'enum' NAME [ ':' type ] '{' [ en ( ',' [ en ] )* ] '}' [ ';' ] | 'delegate' type NAME [ gen ] '(' [ params ] ')' ( where )* ';'
en: ( attr )* NAME [ ASSIGN expr ]
where: 'where' NAME ':' wh ( ',' wh )*
wh: 'class' [ '?' ] | 'struct' | 'new' '(' ')' | type
gen: '<' [ ( attr )* [ 'in' | 'out' ] NAME ( ',' [ 'in' | 'out' ] NAME )* ] '>'
body: '{' ( member )* '}'
member: ';' | attr | ( MOD )+ mrest | mrest
mrest: tdecl | 'event' type NAME ( ';' | ASSIGN expr ';' | '{' ( acc )* '}' ) | 'const' type NAME ASSIGN expr ( ',' NAME ASSIGN expr )* ';' | '~' NAME '(' ')' fbody | ( 'implicit' | 'explicit' ) 'operator' type '(' params ')' fbody | type ( '(' [ params ] ')' [ ':' ( 'base' | 'this' ) '(' [ args ] ')' ] fbody | 'operator' OPS '(' params ')' fbody | 'this' '[' params ']' props | mname )
mname: NAME ( '.' NAME )* ( [ gen ] '(' [ params ] ')' ( where )* fbody | props [ ASSIGN expr ';' ] | [ ASSIGN init ] ( ',' NAME [ ASSIGN init ] )* ';' )
props: '{' ( acc )* '}' | '=>' expr ';'
acc: attr | ( MOD )* NAME ( ';' | block | '=>' expr ';' )
fbody: block | ';' | '=>' expr ';'
init: '{' [ init ( ',' [ init ] )* ] '}' | expr
params: param ( ',' param )*
param: ( attr )* ( 'this' | 'ref' | 'out' | 'in' | 'params' )* type NAME [ ASSIGN expr ]
type: ( ( NAME | PRIM ) [ targs ] ( ( '.' | '::' ) NAME [ targs ] )* | '(' type [ NAME ] ( ',' type [ NAME ] )* ')' ) ( '[' ( ',' )* ']' | '?' | STAR )*
targs: '<' [ type ( ',' type )* ] '>'
block: '{' ( stmt )* '}'
stmt: ';' | block | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [ local ] ';' [ expr ] ';' [ expr ( ',' expr )* ] ')' stmt | [ 'await' ] 'foreach' '(' type NAME 'in' expr ')' stmt | 'switch' '(' expr ')' '{' ( 'case' carg [ 'when' expr ] ':' | 'default' ':' | stmt )* '}'
  | 'try' block ( 'catch' [ '(' type [ NAME ] ')' ] [ 'when' '(' expr ')' ] block )* [ 'finally' block ] | 'return' [ expr ] ';' | 'throw' [ expr ] ';' | 'break' ';' | 'continue' ';' | 'goto' ( 'case' expr | 'default' | NAME ) ';' | 'lock' '(' expr ')' stmt | 'using' ( '(' local ')' stmt | local ';' ) | ( 'unsafe' | 'checked' | 'unchecked' ) block | 'fixed' '(' local ')' stmt | 'yield' ( 'return' expr | 'break' ) ';' | 'const' local ';' | ( MOD )+ local ';' | local ( ';' | ':' stmt | block )
local: expr ( ',' expr )* [ NAME [ ASSIGN init ] ( ',' NAME [ ASSIGN init ] )* ]
carg: operand ( bin operand )* [ NAME ]
expr: cond [ ASSIGN ( expr | '{' [ init ( ',' [ init ] )* ] '}' ) | '=>' ( block | expr ) ]
cond: ors [ '?' expr ':' expr ]
ors: operand ( bin operand )* [ 'switch' '{' [ sarm ( ',' [ sarm ] )* ] '}' ] [ 'with' '{' [ ini ( ',' [ ini ] )* ] '}' ]
sarm: carg [ 'when' expr ] '=>' expr
bin: BIN | SIGN | STAR | '&' | '|' | '<' | '>' [ '>' ] | 'is' [ 'not' ] | 'as' | 'and' | 'or'
operand: ( PRE | SIGN | STAR | '&' | '~' | '++' | '--' | 'await' | 'ref' | 'out' | 'throw' | 'not' )* atom ( ( '.' | '?.' | '::' ) NAME | ( '(' | '?(' ) [ args ] ')' | ( '[' | '?[' ) [ args ] ']' | '++' | '--' | '!' )*
atom: NAME | GENERIC | PRIM | NUM | STR | 'null' | 'true' | 'false' | 'this' | 'base' | '(' [ arg ( ',' arg )* ] ')' [ operand ] | '[' [ args ] ']' | 'new' ( '(' [ args ] ')' [ oinit ] | type ( '(' [ args ] ')' [ oinit ] | oinit | '[' args ']' [ oinit ] ) | oinit | '[' ']' oinit ) | ( 'typeof' | 'sizeof' | 'nameof' | 'default' | 'checked' ) [ '(' type ')' ] | 'delegate' [ '(' [ params ] ')' ] block | 'async' expr | 'static' expr
oinit: '{' [ ini ( ',' [ ini ] )* ] '}'
ini: '{' [ args ] '}' | expr
args: arg ( ',' [ arg ] )*
arg: expr [ ':' expr | NAME ]
"""

CPP = r"""
file: ( top )* EOF
top: ';' | 'namespace' [ NAME ( '::' NAME )* ] ( '{' ( top )* '}' | ASSIGN qual ';' ) | 'template' tlist top | 'using' ( 'namespace' qual ';' | NAME ( ASSIGN type ';' | ( '::' NAME )* ';' ) ) | 'typedef' ( tagdef | type ) [ NAME ] [ '[' [ expr ] ']' ] ';' | 'extern' STR ( '{' ( top )* '}' | decl ) | 'static_assert' '(' args ')' ';' | attr | decl
attr: '[' '[' ( NAME | '::' | '(' args ')' | ',' )* ']' ']'
tlist: '<' [ tpar ( ',' tpar )* ] '>'
tpar: ( 'typename' | 'class' ) [ '...' ] [ NAME ] [ ASSIGN type ] | type [ NAME ] [ ASSIGN ( NUM | STR | PRIM | qual | 'true' | 'false' | 'nullptr' ) ]
decl: ( MOD )* ( tagdef [ declr ( ',' declr )* ] ';' | '~' NAME '(' ')' fend | 'operator' type '(' ')' fend | type ( ptr )* drest )
drest: ';' | '(' [ params ] ')' fend | declr ( '(' [ params ] ')' fend | [ '[' [ expr ] ']' ] ( '[' [ expr ] ']' )* [ ASSIGN init | '{' [ inits ] '}' | ':' expr ] ( ',' declr [ ASSIGN init ] )* ';' )
declr: ( ptr )* ( NAME | 'operator' ( OPS | '(' ')' | '[' ']' ) ) ( '::' ( NAME | '~' NAME | 'operator' OPS ) )*
ptr: STAR | '&' | '&&' | 'const'
fend: ( MODF | 'const' | '&' | '&&' | 'throw' '(' ')' )* [ '->' type ] ( ';' | ASSIGN ( NUM | 'default' | 'delete' ) ';' | [ ':' minit ( ',' minit )* ] block | 'try' block ( 'catch' '(' catchp ')' block )+ )
minit: qual ( '(' [ args ] ')' | '{' [ inits ] '}' )
tagdef: ( 'class' | 'struct' | 'union' ) [ NAME ( '::' NAME )* [ targs ] ] [ MODF ] [ ':' basec ( ',' basec )* ] [ '{' ( ( 'public' | 'private' | 'protected' ) ':' | top )* '}' ] | 'enum' [ 'class' | 'struct' ] [ NAME ] [ ':' type ] [ '{' [ en ( ',' [ en ] )* ] '}' ]
basec: ( 'public' | 'private' | 'protected' | 'virtual' )* qual
en: NAME [ ASSIGN expr ]
params: param ( ',' param )*
param: '...' | type ( ptr )* [ '...' ] [ NAME ] ( '[' [ expr ] ']' )* [ ASSIGN init ]
type: ( 'const' | 'typename' | 'struct' | 'volatile' )* ( qual | PRIM ( PRIM )* ) ( 'const' )*
qual: [ '::' ] NAME [ targs ] ( '::' ( NAME | 'template' NAME ) [ targs ] )*
targs: '<' [ ta ( ',' ta )* ] '>'
ta: NUM | type ( ptr )* [ '(' [ params ] ')' ] [ '...' ]
block: '{' ( stmt )* '}'
stmt: ';' | block | 'if' [ 'constexpr' ] '(' simple [ ';' simple ] ')' stmt [ 'else' stmt ] | 'while' '(' simple ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' ( ';' frest | simple ( ':' expr ')' stmt | ';' frest ) ) | 'switch' '(' expr ')' '{' ( 'case' cond ':' | 'default' ':' | stmt )* '}' | 'try' block ( 'catch' '(' catchp ')' block )+ | 'return' [ init ] ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';'
  | 'throw' [ expr ] ';' | 'using' ( 'namespace' qual ';' | NAME ( ASSIGN type ';' | ( '::' NAME )* ';' ) ) | 'delete' [ '[' ']' ] expr ';' | tagdef [ declr ] ';' | simple ( ';' | ':' stmt )
catchp: '...' | type ( ptr )* [ NAME ]
frest: [ expr ] ';' [ expr ( ',' expr )* ] ')' stmt
simple: ( MOD | 'const' )* expr ( ',' expr )* [ ( ptr )* NAME ( '[' [ expr ] ']' )* [ '(' [ args ] ')' | '{' [ inits ] '}' ] [ ASSIGN init ] ( ',' ( ptr )* NAME [ ASSIGN init ] )* | '[' NAME ( ',' NAME )* ']' ASSIGN init ]
init: '{' [ inits ] '}' | expr
inits: init ( ',' [ init ] )*
expr: cond [ ASSIGN init ]
cond: ors [ '?' expr ':' expr ]
ors: operand ( bin operand )*
bin: BIN | SIGN | STAR | '&' | '&&' | '<' | '>' [ '>' ]
operand: ( PRE | SIGN | STAR | '&' | '~' | '!' | '++' | '--' | 'co_await' )* atom ( ( '.' | '->' ) [ 'template' ] ( NAME | '~' NAME | GENERIC ) | '::' ( NAME | GENERIC ) | '(' [ args ] ')' | '[' expr ']' | '++' | '--' | '{' [ inits ] '}' )*
atom: NAME | GENERIC | [ 'typename' ] PRIM ( PRIM )* | '::' ( NAME | GENERIC ) | NUM | STR+ | 'nullptr' | 'true' | 'false' | 'this' | '(' expr ( ',' expr )* ')' [ operand ] | '[' [ cap ( ',' cap )* ] ']' [ '(' [ params ] ')' ( MODF )* [ '->' type ] block | block ] | 'new' type ( ptr )* [ '(' [ args ] ')' | '{' [ inits ] '}' | '[' expr ']' ] | 'sizeof' operand | 'delete' [ '[' ']' ] operand
cap: ASSIGN | '&' [ NAME ] | [ STAR ] 'this' | NAME [ ASSIGN expr ]
args: init ( ',' init )*
"""

_SCRIPT = r"""
file: ( stmt )* EOF
block: '{' ( stmt )* '}'
stmt: ';' | block | 'import' ( STR | '(' expr ')' post_stmt | clause 'from' STR ) semi | 'export' exported | '@' expr_d | ( 'const' | 'let' | 'var' ) vars semi | 'function' fdef | 'async' ( 'function' fdef | exprs semi ) | 'class' cdef | 'if' '(' exprs ')' stmt [ 'else' stmt ] | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' semi
  | 'for' [ 'await' ] '(' ( ';' frest | ( 'const' | 'let' | 'var' ) vars ( ( 'of' | 'in' ) exprs ')' stmt | ';' frest ) | exprs ( 'of' expr ')' stmt | ';' frest ) ) | 'switch' '(' exprs ')' '{' ( 'case' exprs_m ':' ( stmt )* | 'default' ':' ( stmt )* )* '}' | 'try' block ( 'catch' [ '(' target ')' ] block [ 'finally' block ] | 'finally' block )
  | 'return' ( exprs semi | semi ) | 'throw' exprs semi | 'break' [ NAME ] semi | 'continue' [ NAME ] semi | 'debugger' semi TSSTMT | exprs ( ':' stmt | semi )
semi: ';'
post_stmt: ';' | '.' exprs
expr_d: name [ '.' name ] [ '(' [ args ] ')' ]
exported: 'default' ( 'function' fdef0 | 'class' cdef0 | 'async' 'function' fdef0 | exprs semi ) | STAR [ 'as' name ] 'from' STR semi | '{' [ spec ( ',' [ spec ] )* ] '}' [ 'from' STR ] semi | ( 'const' | 'let' | 'var' ) vars semi | 'function' fdef | 'async' 'function' fdef | 'class' cdef TSEXPORT
clause: ( name [ ',' ( STAR 'as' name | '{' [ spec ( ',' [ spec ] )* ] '}' ) ] | STAR 'as' name | '{' [ spec ( ',' [ spec ] )* ] '}' )
spec: ( name | STR | 'default' ) [ 'as' ( name | 'default' ) ]
frest: [ exprs ] ';' [ exprs ] ')' stmt
vars: var ( ',' var )*
var: target [ ASSIGN expr ]
target: ( name | '[' [ elems ] ']' | '{' [ props ] '}' ) ANNOT
fdef: [ STAR ] name GEN '(' [ params ] ')' RET ( block | SEMIDECL )
fdef0: [ STAR ] [ name ] GEN '(' [ params ] ')' RET block
cdef: name GEN [ 'extends' heir ] IMPL '{' ( member )* '}'
cdef0: [ name ] GEN [ 'extends' heir ] IMPL '{' ( member )* '}'
heir: name ( '.' name | '(' [ args ] ')' )* TARGS
member: ';' | '@' expr_d | MEMBERMOD ( 'static' )* MEMBERMOD ( block | [ 'async' ] [ STAR ] mkey OPT ( GEN2 '(' [ params ] ')' RET ( block | ';' ) | ANNOT [ ASSIGN expr ] ';' ) )
mkey: name | NUM | STR | '[' expr ']' | PRIVATE
params: param ( ',' [ param ] )*
param: ( '@' expr_d )* PARAMMOD ( '...' target | target OPT2 [ ASSIGN expr ] )
exprs: expr ( ',' expr )*
exprs_m: expr_m ( ',' expr_m )*
EXPRESSION
elems: elem ( elem )*
elem: ',' | '...' expr | expr
props: prop ( ',' [ prop ] )*
prop: '...' expr | 'async' [ STAR ] pkey ptail | STAR pkey ptail | pkey [ pkey ] ptail
pkey: name | KEYWORD | NUM | STR | '[' expr ']'
ptail: [ ':' expr | '(' [ params ] ')' RET block ] [ ASSIGN expr ]
args: arg ( ',' [ arg ] )*
arg: '...' expr | expr
name: NAME | 'of' | 'as' | 'from' CONTEXT
"""
_SCRIPT_EXPRESSION = r"""
expr: [ 'async' ] ternary [ ASSIGN expr | '=>' ( FUNBRACE ( stmt )* '}' | expr ) ] | 'yield' [ [ STAR ] expr ]
ternary: ors [ '?' expr_m ':' expr ]
ors: operand ( bin operand )*
bin: BIN | SIGN | STAR | '<' | '>' [ '>' [ '>' ] ] | 'instanceof' | 'in'
operand: ( PRE | SIGN | '!' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* atom ( ( '.' | '?.' ) ( name | KEYWORD | PRIVATE | '(' [ args ] ')' | '[' exprs ']' ) | '(' [ args ] ')' | '[' exprs ']' | TPL | '++' | '--' POSTFIX )*
atom: name | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | 'function' fdef0 | 'class' cdef0 | 'new' newtail | '(' [ pitems ] ')' PARENTAIL | '[' [ elems ] ']' | '{' [ props ] '}' | 'import' ( '(' expr ')' | '.' name )
newtail: 'new' newtail | '.' name | ( name | 'this' | 'class' cdef0 | '(' exprs ')' ) ( '.' name | '[' expr ']' )* TARGS
pitems: pitem ( ',' [ pitem ] )*
pitem: '...' target | expr PITEM
"""


def _script(typed: bool) -> str:
    """JavaScript, or TypeScript with its annotations, types and declarations."""
    fill = {
        "ANNOT": "[ ':' type ]", "GEN2": "[ gen ]", "GEN": "[ gen ]", "RET": "[ ':' rtype ]", "IMPL": "[ 'implements' type ( ',' type )* ]", "TARGS": "[ targs ]", "OPT2": "[ '?:' type ]",
        "OPT": "[ '?:' type | '!' ]", "SEMIDECL": "';'", "MEMBERMOD": "( MOD | 'readonly' | 'abstract' | 'declare' )*", "PARAMMOD": "( MOD | 'readonly' )*", "PITEM": "[ ':' type | '?:' type ] [ ASSIGN expr ]",
        "TSSTMT": "| 'interface' name [ gen ] [ 'extends' type ( ',' type )* ] tbody | 'enum' name '{' [ en ( ',' [ en ] )* ] '}' | 'namespace' name ( '.' name )* block | 'declare' stmt | 'abstract' 'class' cdef | 'type' name [ gen ] ASSIGN type semi",
        "TSEXPORT": "| 'interface' name [ gen ] [ 'extends' type ( ',' type )* ] tbody | 'enum' name '{' [ en ( ',' [ en ] )* ] '}' | 'const' 'enum' name '{' [ en ( ',' [ en ] )* ] '}' | 'namespace' name ( '.' name )* block | 'declare' stmt | 'abstract' 'class' cdef | 'type' ( name [ gen ] ASSIGN type semi | '{' [ spec ( ',' [ spec ] )* ] '}' [ 'from' STR ] semi )",
        "CONTEXT": "| 'get' | 'set' | 'is'", "POSTFIX": "| '!' | 'as' type | 'satisfies' type", "PARENTAIL": "[ ':' rtype ]",
    }
    plain = dict.fromkeys(fill, "") | {"CONTEXT": "| 'get' | 'set' | 'type'", "SEMIDECL": "';'"}
    text = _SCRIPT.replace("EXPRESSION\n", _SCRIPT_EXPRESSION + "MIDDLE\n")
    middle = _SCRIPT_EXPRESSION.replace("PARENTAIL", "")
    # in the middle of a conditional and after case, a colon after a bracket is no return type
    for rule in ("expr", "ternary", "ors", "operand", "atom"):
        middle = re.sub(rf"(?<![\w'_]){rule}(?![\w'])", f"{rule}_m", middle)
    keep = [x for x in middle.strip().split("\n") if x.split(":")[0] in ("expr_m", "ternary_m", "ors_m", "operand_m", "atom_m")]
    # inside brackets everything is as usual again
    text = text.replace("MIDDLE\n", "\n".join(_usual_inside(x) for x in keep) + "\n")
    for k, v in sorted((fill if typed else plain).items(), key=lambda kv: -len(kv[0])):
        text = text.replace(k, v) if " " in k else re.sub(rf"(?<![\w'])(?:{k})(?![\w'])", lambda m, v=v: v, text)
    text = text.replace("KEYWORD", "KEY")
    if typed:
        text += _TYPES
    return text


def _usual_inside(rule: str) -> str:
    out, depth = [], 0
    for t in rule.split(" "):
        if t in ("'('", "'['", "'{'", "FUNBRACE"):
            depth += 1
        elif t in ("')'", "']'", "'}'"):
            depth -= 1
        out.append(t.replace("_m", "") if depth > 0 else t)
    return " ".join(out)


_TYPES = r"""
en: ( name | STR ) [ ASSIGN expr ]
gen: '<' gpar ( ',' [ gpar ] )* '>'
gpar: [ 'const' ] name [ 'extends' type ] [ ASSIGN type ]
targs: '<' type ( ',' type )* '>'
rtype: type [ 'is' type ]
type: [ '|' | BIN ] tunary ( ( BIN | '|' ) tunary )* [ 'extends' type '?' type ':' type ]
tunary: ( 'keyof' | 'readonly' | 'typeof' | 'infer' | 'unique' )* tatom ( '[' [ type ] ']' )*
tatom: name ( '.' name )* [ targs ] | 'void' | 'null' | 'this' | 'true' | 'false' | STR | TPL | [ SIGN ] NUM | 'new' '(' [ params ] ')' '=>' rtype | '(' [ params_t ] ')' [ '=>' rtype ] | [ gen ] '(' [ params ] ')' '=>' rtype | '[' [ telem ( ',' [ telem ] )* ] ']' | tbody | 'import' '(' STR ')' ( '.' name )* | 'asserts' name
telem: [ '...' ] type [ ':' type | '?:' type ]
params_t: ptype ( ',' [ ptype ] )*
ptype: '...' name [ ':' type ] | type [ ':' type | '?:' type ]
tbody: ( '{' | FUNBRACE ) [ tmem ( tmem )* ] '}'
tmem: ';' | ',' | ( 'readonly' )* tkey [ '?:' type | ':' type | [ gen ] '(' [ params ] ')' [ ':' rtype ] ] | [ 'new' ] '(' [ params ] ')' [ ':' rtype ]
tkey: name | KEY | STR | NUM | '[' name [ ( 'in' | ':' ) type ] ']'
"""


def _words(text: str, token: str | None = None) -> dict[str, str]:
    return {w: token or w for w in text.split()}


# The key words of each language and the token each becomes.
KEYWORDS = {
    "python": _words(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
    ),
    "gdscript": _words(
        "and as assert await break breakpoint class class_name const continue elif else enum extends false for func if in is match not null or pass return self signal static true var while yield onready export setget tool"
    ),
    "ruby": _words(
        "alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__"
    ),
    "go": _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
    "rust": _words(
        "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while"
    )
    | _words("true false", "NUM"),
    "java": _words(
        "assert break case catch class continue do else enum extends final finally for if implements import instanceof interface new null package record return super switch synchronized this throw throws try while true false yield default"
    )
    | _words("public private protected static abstract native transient volatile strictfp sealed", "MOD")
    | _words("void int long double float boolean char byte short", "PRIM"),
    "c_sharp": _words(
        "as base break case catch checked class const continue default delegate do else enum event explicit false finally fixed for foreach goto if implicit in interface is lock namespace new null operator out params ref return sizeof static struct switch this throw true try typeof unchecked unsafe using while record yield where await global"
    )
    | _words("public private protected internal abstract sealed virtual override readonly extern partial async volatile", "MOD")
    | _words("void int long double float bool char byte short string object decimal uint ulong ushort sbyte", "PRIM"),
    "cpp": _words(
        "break case catch class const constexpr continue default delete do else enum extern false for goto if namespace new nullptr operator private protected public return sizeof static_assert struct switch template this throw true try typedef typename union using virtual while volatile"
    )
    | _words("static inline explicit friend mutable thread_local register consteval constinit", "MOD")
    | _words("noexcept override final", "MODF")
    | _words("void int long double float bool char short unsigned signed wchar_t", "PRIM"),
    "javascript": _words(
        "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return static super switch this throw true try typeof var void while yield of as from get set"
    ),
}
KEYWORDS["cpp"] |= {"virtual": "MOD", "constexpr": "MOD"}
KEYWORDS["c_sharp"] |= {"static": "MOD", "new": "new"}
KEYWORDS["typescript"] = KEYWORDS["javascript"] | _words("implements interface enum namespace declare type keyof readonly infer unique asserts is satisfies abstract") | _words("public private protected override", "MOD")

# Operators that are tokens of their own; any other operator is BIN, PRE, SIGN or ASSIGN.
OWN = {
    "python": "( ) [ ] { } , : ; . @ -> := ** / ...",
    "gdscript": "( ) [ ] { } , : ; . @ -> ** /",
    "ruby": "( ) [ ] { } , ; . :: ** & | < << / => -> ? :",
    "go": "( ) [ ] { } , : ; . := <- & | / ++ -- ... ~",
    "rust": "( ) [ ] { } , : ; . :: -> => & | || < > ! ? @ # $ .. ..=",
    "java": "( ) [ ] { } , : ; . :: -> & | < > ? @ ++ -- ...",
    "c_sharp": "( ) [ ] { } , : ; . :: => & | < > ? ?. ++ -- ! ~",
    "cpp": "( ) [ ] { } , : ; . :: -> & && < > ? ++ -- ! ~ ...",
    "javascript": "( ) [ ] { } , : ; . => < > ? ?. ?: ++ -- ! @ ... |",
}
OWN["typescript"] = OWN["javascript"]
GRAMMARS = {
    "python": PYTHON, "gdscript": GDSCRIPT, "ruby": RUBY, "go": GO, "rust": RUST, "java": JAVA, "c_sharp": C_SHARP, "cpp": CPP,
    "javascript": _script(False), "typescript": _script(True),
}
