"""Lexers and grammars of the languages whose files are checked.

The grammars describe the public language definitions on the level that a
truncated, spliced, conflicted or misnamed file breaks; where a construct
can't be told from another by tokens alone, they accept both.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from codeweft.llm.grammar import NEWLINE, UNKNOWN, Grammar

STRING = r"\"(?:[^\"\\\n]|\\.)*\""
NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.(?!\.|[A-Za-z_])[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)"
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*(?s:.*?)\*/"

GO = """
unit = 'package' id ';' | 'import' ( spec | '(' ( spec ';' )* spec? ')' ) ';' | top ';' | ';'
spec = ( id | '.' )? str
top = 'func' params? id tparams? sig block? | decl
tparams = '[' id ( ',' id )* type ( ',' id ( ',' id )* type )* ','? ']'
decl = 'var' ( vspec | '(' ( vspec ';' )* vspec? ')' ) | 'const' ( cspec | '(' ( cspec ';' )* cspec? ')' ) | 'type' ( tspec | '(' ( tspec ';' )* tspec? ')' )
vspec = id ( ',' id )* ( '=' exprs | type ( '=' exprs )? )
cspec = id ( ',' id )* ( '=' exprs | type '=' exprs )?
tspec = id tparams? '='? type
sig = params ( params | type )?
params = '(' ( param ( ',' param )* ','? )? ')'
param = id '...'? type | '...' type | type
type = id ( '.' id )? targs? | '*' type | '(' type ')' | typelit | 'func' sig
targs = '[' type ( ',' type )* ','? ']'
typelit = '[' ( '...' | expr )? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'struct' '{' ( field ';' )* field? '}' | 'interface' '{' ( member ';' )* member? '}'
field = id ( ',' id )* type str? | '*'? id ( '.' id )? targs? str?
member = id sig | '~'? type ( '|' '~'? type )*
block = '{' stmts '}'
stmts = ( stmt? ';' )* stmt?
stmt = decl | 'return' exprs? | 'if' head block ( 'else' ifelse )? | 'for' fhead? block | 'switch' shead? '{' cases '}' | 'select' '{' cases '}' | 'go' expr | 'defer' expr | 'break' id? | 'continue' id? | 'goto' id | 'fallthrough' | block | id ':' stmt? | simple
ifelse = 'if' head block ( 'else' ifelse )? | block
head = ( hsimple ';' )? hsimple
shead = ( hsimple? ';' )? hsimple?
fhead = 'range' hexpr | hsimple? ';' hsimple? ';' hsimple? | hsimple
cases = ( ( 'case' ctype | 'default' ) ':' stmts )*
ctype = ( expr | type ) ( ',' ( expr | type ) )* ( ( '=' | ':=' ) exprs )?
simple = exprs ( ( '=' | ':=' | 'op=' ) 'range'? exprs | '++' | '--' )?
hsimple = hexprs ( ( '=' | ':=' | 'op=' ) 'range'? hexprs | '++' | '--' )?
exprs = expr ( ',' expr )*
hexprs = hexpr ( ',' hexpr )*
expr = unary ( bin unary )*
hexpr = hunary ( bin hunary )*
bin = 'op' | '*' | '+' | '-' | '&' | '^' | '|' | '<-'
unary = pre* operand ( suffix | lit )*
hunary = pre* operand suffix*
pre = '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'
operand = num | str | id | 'func' sig block? | typelit ( lit | '(' expr ','? ')' )? | '(' ( expr | type ) ')'
suffix = '.' ( id | '(' ( 'type' | type ) ')' ) | '[' expr? ( ':' expr? )* ( ',' type )* ']' | '(' ( expr '...'? ( ',' expr '...'? )* ','? )? ')'
lit = '{' ( elem ( ',' elem )* ','? )? '}'
elem = ( expr | lit ) ( ':' ( expr | lit ) )?
"""

C = """
unit = directive | ext | ';'
ext = 'typedef'? spec ( ';' | declarator ( block | rest ) )
rest = ( '=' init )? ( ',' declarator ( '=' init )? )* ';'
spec = qual* ( base ( base | qual )* | ( 'struct' | 'union' ) id? body? | 'enum' id? ( '{' enums ','? '}' )? | id ) qual*
body = '{' ( spec ( member ( ',' member )* )? ';' | ';' | directive )* '}'
enums = id ( '=' cond )? ( ',' id ( '=' cond )? )*
member = declarator ( ':' cond )? | ':' cond
declarator = ( '*' qual* )* ( id | '(' declarator ')' ) dims*
dims = '[' qual* expr? ']' | '(' ( pars | ids )? ')'
pars = par ( ',' ( par | '...' ) )*
par = spec ( declarator | abstract )?
ids = id ( ',' id )*
abstract = ( '*' qual* )+ adims* | adims+
adims = '(' abstract ')' | '[' expr? ']' | '(' pars? ')'
init = assign | '{' ( item ( ',' item )* ','? )? '}'
item = ( ( '.' id | '[' cond ']' )+ '=' )? init
block = '{' stmt* '}'
stmt = block | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' '(' ( local | expr? ';' ) expr? ';' expr? ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'switch' '(' expr ')' stmt | 'case' cond ( '...' cond )? ':' | 'default' ':' | 'return' ( expr | init )? ';' | 'break' ';' | 'continue' ';' | 'goto' id ';' | directive | id ':' | local | expr? ';'
local = 'typedef'? spec ( ';' | declarator rest )
expr = assign ( ',' assign )*
assign = cond ( ( '=' | 'op=' ) ( assign | init ) )?
cond = binary ( '?' expr? ':' cond )?
binary = unary ( ( 'op' | '*' | '+' | '-' | '&' ) unary )*
unary = ( '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' )* ( 'sizeof' ( '(' tname ')' | unary ) | '(' tname ')' ( unary | init ) | primary suffix* )
tname = spec abstract?
primary = num | str+ | id str* | '(' ( expr | block ) ')'
suffix = '[' expr ']' | '(' ( arg ( ',' arg )* )? ')' | '.' id | '->' id | '++' | '--'
arg = assign | tname
"""

JAVA = """
unit = annot* 'package' name ';' | 'import' 'static'? name ( '.' '*' )? ';' | tdecl | ';'
name = ident ( '.' ident )*
ident = id | soft
annot = '@' name ( '(' ( aval ( ',' aval )* )? ')' )?
aval = ( ident '=' )? ( annot | '{' ( aval ( ',' aval )* ','? )? '}' | cond )
mods = ( mod | 'static' | 'final' | 'default' | annot )*
tdecl = mods tbody
tbody = 'class' ident tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? cbody | '@'? 'interface' ident tparams? ( 'extends' types )? ( 'permits' types )? cbody | 'enum' ident ( 'implements' types )? '{' econsts? ( ';' member* )? '}' | 'record' ident tparams? '(' params? ')' ( 'implements' types )? cbody
econsts = econst ( ',' econst )* ','?
econst = annot* ident args? cbody?
tparams = '<' tparam ( ',' tparam )* '>'
tparam = annot* ident ( 'extends' type ( '&' type )* )?
types = type ( ',' type )*
type = annot* ( prim | ident targs? ( '.' annot* ident targs? )* ) ( annot* '[' ']' )*
targs = '<' ( targ ( ',' targ )* )? '>'
targ = annot* '?' ( ( 'extends' | 'super' ) type )? | type
cbody = '{' member* '}'
member = ';' | mods ( tbody | block | tparams? ( ident '(' params? ')' throws? block | ident block | ( 'void' | type ) ident ( '(' params? ')' dims throws? ( block | ';' | 'default' aval ';' ) | vars ';' ) ) )
throws = 'throws' types
params = param ( ',' param )*
param = ( 'final' | annot )* type annot* '...'? ( ident '.' )? ( ident | 'this' ) dims
dims = ( '[' ']' )*
vars = dims ( '=' vinit )? ( ',' ident dims ( '=' vinit )? )*
vinit = arr | expr
arr = '{' ( vinit ( ',' vinit )* )? ','? '}'
block = '{' stmt* '}'
stmt = block | ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' '(' fhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'try' ( '(' res ( ';' res )* ';'? ')' )? block ( 'catch' '(' ( 'final' | annot )* type ( '|' type )* ident ')' block )* ( 'finally' block )? | 'switch' '(' expr ')' sbody | 'throw' expr ';' | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | ident ':' stmt | local ';' | mods tbody | 'yield' expr ';' | expr ';'
local = ( 'final' | annot )* type ident vars
fhead = ( 'final' | annot )* type ident ':' expr | ( local | exprs )? ';' expr? ';' exprs?
res = local | expr
sbody = '{' ( ( 'case' label ( ',' label )* ( 'when' expr )? | 'default' ) ( ':' stmt* | '->' ( block | 'throw' expr ';' | expr ';' ) ) )* '}'
label = 'default' | type ident | cond
exprs = expr ( ',' expr )*
expr = lambda | cond ( ( '=' | 'op=' | '>' '>' '='  | '>' '>' '>' '=' | '>' '=' ) expr )?
lambda = ( ident | '(' ( params | ident ( ',' ident )* )? ')' ) '->' ( block | expr )
cond = binary ( '?' ( lambda | cond ) ':' ( lambda | cond ) )?
binary = unary ( bin unary | 'instanceof' 'final'? type ident? )*
bin = 'op' | '*' | '+' | '-' | '&' | '|' | '<' '=' | '<' '<'? | '>' '>' '>' | '>' '>' | '>' '=' | '>'
unary = ( '+' | '-' | '!' | '~' | '++' | '--' )* ( '(' prim dims ')' unary | '(' type ( '&' type )* ')' cast | postfix )
cast = ( '!' | '~' ) unary | lambda | postfix
postfix = primary suffix*
primary = num | str | 'this' | 'super' | 'switch' '(' expr ')' sbody | 'new' annot* creator | '(' expr ')' | 'void' '.' 'class' | prim dims ( '.' 'class' | '::' ( ident | 'new' ) ) | ident targs dims '::' ( ident | 'new' ) | ident ( '[' ']' )+ ( '.' 'class' | '::' 'new' ) | ident
creator = targs? type1 ( ( '[' expr ']' )+ dims | dims1 arr | '(' exprs? ')' cbody? )
type1 = prim | ident targs? ( '.' ident targs? )*
dims1 = ( '[' ']' )+
suffix = '.' ( targs? ident | 'this' | 'class' | 'super' | 'new' creator ) | '[' expr ']' | args | '++' | '--' | '::' targs? ( ident | 'new' )
args = '(' exprs? ')'
soft = 'record' | 'permits' | 'yield' | 'when'
"""

SCRIPT = """
unit = ( importdecl | exportdecl | stmt )*
name = id | soft
key = name | word
importdecl = 'import' ( str | TYPE? ( name ( ',' ( nspace | named ) )? | nspace | named ) 'from' str ) ( 'with' object )? eos
nspace = '*' 'as' name
named = '{' ( spec ( ',' spec )* ','? )? '}'
spec = TYPE? ( key | str ) ( 'as' ( key | str ) )?
exportdecl = 'export' ( 'default' ( function | class | 'abstract' class | expr eos ) | '*' ( 'as' ( key | str ) )? 'from' str eos | TYPE? named ( 'from' str )? eos | decl )
decl = 'async'? function | decorator* 'abstract'? class | variables eos | tsdecl
function = 'function' '*'? name? generics? params rtype ( block | eos )
class = 'class' name? generics? ( 'extends' unary targs? )? ( IMPLEMENTS types )? cbody
decorator = '@' name ( '.' key )* args?
cbody = '{' ( ';' | member )* '}'
member = decorator* mods ( 'static' block | '*'? pname mark ( generics? params rtype ( block | eos ) | annot ( '=' assign )? eos ) )
mods = ( mod &mnext )*
mnext = key | '#' | str | num | '[' | '*' | '{'
mod = 'static' | 'async' | 'get' | 'set' | MODIFIER
pname = '#'? key | str | num | '[' ( assign | name ':' type ) ']'
params = '(' ( param ( ',' param )* ','? )? ')'
param = decorator* pmods ( '...' )? ( pattern | 'this' ) mark annot ( '=' assign )?
pmods = ( MODIFIER &pnext )*
pnext = name | '{' | '['
pattern = name | '[' ( pelem? ( ',' pelem? )* )? ']' | '{' ( pprop ( ',' pprop )* ','? )? '}'
pelem = '...'? pattern ( '=' assign )?
pprop = '...' pattern | pname ( ':' pattern )? ( '=' assign )?
block = '{' stmt* '}'
variables = ( 'const' | 'let' | 'var' ) binding ( ',' binding )*
binding = pattern mark annot ( '=' assign )?
stmt = block | ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' 'await'? '(' fhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'switch' '(' expr ')' '{' ( ( 'case' expr | 'default' ) ':' stmt* )* '}' | 'try' block ( 'catch' ( '(' pattern annot ')' )? block )? ( 'finally' block )? | 'throw' expr eos | 'return' expr? eos | 'break' name? eos | 'continue' name? eos | 'debugger' eos | decl | name ':' stmt | !brace expr eos
brace = '{'
fhead = ( variables0 | expr )? ( ( 'of' | 'in' ) expr | ';' expr? ';' expr? )
variables0 = ( 'const' | 'let' | 'var' ) binding0 ( ',' binding0 )*
binding0 = pattern annot ( '=' assign0 )?
expr = assign ( ',' assign )*
assign = arrow | 'yield' '*'? assign? | cond ( ( '=' | 'op=' ) assign )?
assign0 = assign
arrow = 'async'? ( name | generics? params rtype ) '=>' ( block | assign )
cond = binary ( '?' assign ':' assign )?
binary = unary ( ( 'op' | '*' | '+' | '-' | '<' | '>' | '&' | '|' | 'in' | 'instanceof' ) unary | AS type )*
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* postfix
postfix = primary suffix*
primary = num | str | regex | template | 'this' | 'super' | 'null' | 'new' ( '.' name | newexpr ) | 'async'? function | class | 'import' ( '.' name | args ) | '(' expr ')' | '[' ( ( '...'? assign )? ( ',' ( '...'? assign )? )* )? ']' | object | '#' name | name
newexpr = primary ( '.' '#'? key | '[' expr ']' )* targs? args?
object = '{' ( prop ( ',' prop )* ','? )? '}'
prop = '...' assign | mods '*'? pname ( generics? params rtype block | ':' assign | ( '=' assign )? )
suffix = '?.' ( '#'? key | '[' expr ']' | args ) | '.' '#'? key | '[' expr ']' | args | template | '++' | '--' | TARGS | BANG
args = '(' ( '...'? assign ( ',' '...'? assign )* ','? )? ')'
soft = 'of' | 'async' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'abstract' | 'await' | 'yield' TSSOFT
word = 'import' | 'export' | 'default' | 'function' | 'class' | 'extends' | 'const' | 'var' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'try' | 'catch' | 'finally' | 'throw' | 'return' | 'break' | 'continue' | 'debugger' | 'in' | 'instanceof' | 'typeof' | 'void' | 'delete' | 'this' | 'super' | 'null' | 'new' | 'with' TSWORD
"""
#: What TypeScript adds, by placeholder; in JavaScript each stands for nothing that can match.
TYPED = {
    "TYPE?": "( 'type' &tnext )?",
    "IMPLEMENTS": "'implements'",
    "MODIFIER": "( 'public' | 'private' | 'protected' | 'readonly' | 'declare' | 'abstract' | 'override' )",
    "AS type": "( 'as' | 'satisfies' ) type",
    "TARGS": "targs &after",
    "BANG": "'!'",
    "TSSOFT": "| 'type' | 'readonly' | 'declare' | 'satisfies' | 'keyof' | 'infer' | 'is' | 'namespace' | 'interface' | 'implements' | 'public' | 'private' | 'protected' | 'override'",
    "TSWORD": "| 'enum'",
}
UNTYPED = {"TYPE?": "", "( IMPLEMENTS types )?": "", "| MODIFIER": "", "( MODIFIER &pnext )*": "( never )?", "| AS type": "", "| TARGS | BANG": "", "TSSOFT": "", "TSWORD": "| 'enum'"}
TYPES = """
tnext = name | '{' | '*'
after = '(' | template
rtype = ( ':' ( ASSERTS type | type ) )?
mark = ( '?' | '!' )?
annot = ( ':' type )?
generics = '<' generic ( ',' generic )* ','? '>'
generic = 'const'? name ( 'extends' type )? ( '=' type )?
targs = '<' type ( ',' type )* ','? '>'
types = type ( ',' type )*
tsdecl = 'declare' ( decl | 'const'? tenum ) | 'interface' name generics? ( 'extends' types )? tobject | 'type' name generics? '=' type eos | 'const'? tenum | 'namespace' name ( '.' name )* '{' ( exportdecl | importdecl | stmt )* '}'
tenum = 'enum' name '{' ( emember ( ',' emember )* ','? )? '}'
emember = ( key | str ) ( '=' assign )?
type = 'new'? generics? params '=>' type | tunion ( 'extends' tunion '?' type ':' type )? ( 'is' type )?
tunion = ( '|' | '&' )? tpost ( ( '|' | '&' ) tpost )*
tpost = ( 'keyof' | 'readonly' | 'infer' )* tprim ( '[' type? ']' )*
tprim = 'typeof' name ( '.' key )* | str | template | '-'? num | 'void' | 'null' | 'this' | '(' type ')' | '[' ( telem ( ',' telem )* ','? )? ']' | tobject | 'import' args ( '.' name )* targs? | 'new' generics? params '=>' type | name ( '.' key )* targs?
telem = '...'? ( name '?'? ':' )? type '?'?
tobject = '{' ( tmember ( ';' | ',' )? )* '}'
tmember = ( '+' | '-' )? ( 'readonly' &mnext )? ( 'new'? generics? params rtype | '[' name ( 'in' type ( 'as' type )? | ':' type ) ']' ( '+' | '-' )? '?'? annot | ( ( 'get' | 'set' ) &mnext )? pname '?'? ( generics? params rtype | annot ) )
"""
PLAIN = """
rtype = ( never )?
mark = ( never )?
annot = ( never )?
generics = never
targs = never
type = never
tsdecl = never
"""

RUST = """
unit = ( '#' '!' tree )* attr* item | ';'
attr = '#' tree
tree = '(' any* ')' | '[' any* ']' | '{' any* '}'
any = tree | id | num | str | life | word | punct
word = 'pub' | 'fn' | 'struct' | 'enum' | 'impl' | 'trait' | 'use' | 'mod' | 'const' | 'static' | 'type' | 'let' | 'mut' | 'if' | 'else' | 'match' | 'for' | 'in' | 'while' | 'loop' | 'return' | 'break' | 'continue' | 'as' | 'ref' | 'move' | 'where' | 'unsafe' | 'async' | 'await' | 'dyn' | 'extern' | 'self' | 'crate' | 'super'
punct = '#' | '!' | ';' | ',' | '.' | ':' | '::' | '->' | '=>' | '=' | 'op=' | 'op' | '*' | '+' | '-' | '&' | '&&' | '|' | '||' | '<' | '>' | '?' | '..' | '@' | '$'
vis = ( 'pub' ( '(' ( 'crate' | 'super' | 'self' | 'in' path ) ')' )? )?
item = vis ( fn | 'struct' id generics? ( where? '{' ( attr* vis id ':' type ( ',' attr* vis id ':' type )* ','? )? '}' | '(' ( attr* vis type ( ',' attr* vis type )* ','? )? ')' where? ';' | where? ';' ) | 'enum' id generics? where? '{' ( variant ( ',' variant )* ','? )? '}' | 'unsafe'? 'impl' generics? '!'? type ( 'for' type )? where? '{' ( attr* item )* '}' | 'unsafe'? 'trait' id generics? ( ':' bounds )? where? '{' ( attr* item )* '}' | 'use' usetree ';' | 'mod' id ( ';' | '{' ( attr* item )* '}' ) | ( 'const' | 'static' 'mut'? ) id ':' type ( '=' expr )? ';' | 'type' id generics? ( ':' bounds )? where? ( '=' type )? ';' | 'extern' ( id 'as' )? ( str? '{' ( attr* item )* '}' | 'crate' id ';' ) | path '!' id? ( '{' any* '}' | tree ';' ) )
fn = ( 'const' | 'async' | 'unsafe' | 'extern' str? )* 'fn' id generics? '(' fparams? ')' ( '->' type )? where? ( block | ';' )
fparams = fparam ( ',' fparam )* ','?
fparam = attr* ( '&'? life? 'mut'? 'self' ( ':' type )? | pat ':' type )
variant = attr* id ( '{' ( vis id ':' type ( ',' vis id ':' type )* ','? )? '}' | '(' ( type ( ',' type )* ','? )? ')' )? ( '=' expr )?
generics = '<' ( generic ( ',' generic )* ','? )? '>'
generic = life ( ':' life ( '+' life )* )? | 'const' id ':' type ( '=' expr )? | id ( ':' bounds )? ( '=' type )?
where = 'where' ( ( life | type ) ':' bounds? ','? )*
bounds = bound ( '+' bound )*
bound = life | '?'? ( 'for' generics )? path | '(' bound ')'
usetree = '::'? ( ( id | 'crate' | 'self' | 'super' ) ( '::' ( id | 'self' | 'super' ) )* ( '::' ( '*' | '{' ( usetree ( ',' usetree )* ','? )? '}' ) )? ( 'as' id )? | '{' ( usetree ( ',' usetree )* ','? )? '}' | '*' )
path = '::'? seg ( '::' seg )*
seg = ( id | 'self' | 'crate' | 'super' ) ( '::'? targs | '(' ( type ( ',' type )* )? ')' ( '->' type )? )?
epath = '::'? eseg ( '::' ( targs | eseg ) )*
eseg = id | 'self' | 'crate' | 'super'
targs = '<' ( targ ( ',' targ )* ','? )? '>'
targ = life | id '=' type | id ':' bounds | type | block | '-'? num
type = ( '&' | '&&' ) life? 'mut'? type | '*' ( 'const' | 'mut' ) type | '[' type ( ';' expr )? ']' | '(' ( type ( ',' type )* ','? )? ')' | '!' | 'dyn' bounds | 'impl' bounds | ( 'for' generics )? ( 'unsafe' | 'extern' str? )* 'fn' '(' ( ( id ':' )? type ( ',' ( id ':' )? type )* ','? )? ')' ( '->' type )? | '<' type ( 'as' path )? '>' '::' path | path
block = '{' ( '#' '!' tree )* stmt* expr? '}'
stmt = ';' | attr* ( 'let' pat ( ':' type )? ( '=' expr ( 'else' block )? )? ';' | item | blocky !more ';'? | expr ';' )
more = '.' | '?'
blocky = ( life ':' )? ( 'unsafe'? block | 'async' 'move'? block | 'if' cond block ( 'else' elses )? | 'match' hexpr '{' arms '}' | 'loop' block | 'while' cond block | 'for' pat 'in' hexpr block )
elses = 'if' cond block ( 'else' elses )? | block
cond = ( 'let' pats '=' hunaryrange | hexpr ) ( '&&' ( 'let' pats '=' hunaryrange | hexpr ) )*
hunaryrange = hexpr1
arms = ( attr* '|'? pats ( 'if' cond0 )? '=>' arm )*
cond0 = expr
arm = blocky !armmore ','? | expr ( ',' | &close )
armmore = '.' | '?' | 'op' | '+' | '-' | 'as'
close = '}'
pats = pat
pat = '|'? pat1 ( '|' pat1 )*
pat1 = ( '&' | '&&' ) 'mut'? pat1 | lit ( '..' lit? )? | '..' lit? | '(' ( pat ( ',' pat )* ','? )? ')' | '[' ( pat ( ',' pat )* ','? )? ']' | 'ref' 'mut'? id | 'mut' id | epath ( '!' tree | '(' ( pat ( ',' pat )* ','? )? ')' | '{' ( fpat ( ',' fpat )* ','? )? '}' | '@' pat1 | '..' lit? )?
fpat = attr* ( '..' | 'ref'? 'mut'? ( id | num ) ( ':' pat )? )
lit = '-'? num | str
expr = range ( ( '=' | 'op=' ) expr )?
range = '..' binary? | binary ( '..' binary? )?
binary = unary ( bin unary | 'as' type )*
hexpr = hrange ( ( '=' | 'op=' ) hexpr )?
hexpr1 = hbinary1
hrange = '..' hbinary? | hbinary ( '..' hbinary? )?
hbinary = hunary ( bin hunary | 'as' type )*
hbinary1 = hunary ( bin1 hunary | 'as' type )*
bin1 = 'op' | '*' | '+' | '-' | '&' | '|' | '<' ( '<' | '=' )? | '>' ( '>' | '=' )?
bin = bin1 | '&&' | '||'
unary = ( '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? )* primary suffix*
hunary = ( '-' | '!' | '*' | ( '&' | '&&' ) 'mut'? )* hprimary suffix*
suffix = '?' | '.' ( 'await' | num | id ( '::' targs )? ) | '(' ( expr ( ',' expr )* ','? )? ')' | '[' expr ']'
closure = 'async'? 'move'? ( '||' | '|' ( cpar ( ',' cpar )* ','? )? '|' ) ( '->' type block | expr )
cpar = pat1 ( ':' type )?
primary = epath '{' ( finit ( ',' finit )* ','? )? '}' | hprimary
finit = attr* ( '..' expr? | ( id | num ) ( ':' expr )? )
hprimary = num | str | blocky | closure | 'return' expr? | 'break' life? expr? | 'continue' life? | '(' ( expr ( ',' expr )* ','? )? ')' | '[' ( expr ( ';' expr | ( ',' expr )* ','? ) )? ']' | '<' type ( 'as' path )? '>' '::' epath | epath ( '!' tree )?
"""

PYTHON = """
unit = stmt
stmt = ifs | 'while' named suite ( 'else' suite )? | 'async'? 'for' targets 'in' stars suite ( 'else' suite )? | 'try' suite ( ( 'except' '*'? ( test ( ',' test )* ( 'as' id )? )? suite )+ ( 'else' suite )? ( 'finally' suite )? | 'finally' suite ) | 'async'? 'with' withs suite | ( '@' named nl )* ( 'async'? 'def' name tpars? '(' params? ')' ( '->' stars )? suite | 'class' name tpars? ( '(' args? ')' )? suite ) | match | simple
ifs = 'if' named suite ( 'elif' named suite )* ( 'else' suite )?
match = 'match' stars ':' nl indent ( 'case' pat ( 'if' named )? suite )+ dedent
suite = ':' ( nl indent stmt+ dedent | simple )
simple = small ( ';' small )* ';'? nl
small = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( test ( 'from' test )? )? | 'global' name ( ',' name )* | 'nonlocal' name ( ',' name )* | 'del' targets | 'assert' test ( ',' test )? | 'import' dotted ( 'as' name )? ( ',' dotted ( 'as' name )? )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | '(' froms ','? ')' | froms ) | 'type' name tpars? '=' test | assign
froms = name ( 'as' name )? ( ',' name ( 'as' name )? )*
dotted = name ( '.' name )*
name = id | 'match' | 'case' | 'type'
tpars = '[' tpar ( ',' tpar )* ','? ']'
tpar = ( '*' | '**' )? name ( ':' test )? ( '=' test )?
assign = stars ( ':' test ( '=' yields )? | 'op=' yields | ( '=' yields )* ) | yield
yields = yield | stars
yield = 'yield' ( 'from' test | stars )?
withs = '(' wtests ','? ')' &colon | wtests
colon = ':'
wtests = test ( 'as' star )? ( ',' test ( 'as' star )? )*
targets = star ( ',' star )* ','?
star = '*'? bitor
stars = ( '*' bitor | named ) ( ',' ( '*' bitor | named ) )* ','?
named = name ':=' test | test
test = lambda | ortest ( 'if' ortest 'else' test )?
lambda = 'lambda' lparams? ':' test
ortest = nottest ( ( 'and' | 'or' ) nottest )*
nottest = 'not'* bitor ( comp bitor )*
comp = 'cmp' | 'in' | 'not' 'in' | 'is' 'not'?
bitor = unary ( ( 'op' | '*' | '**' | '+' | '-' | '@' ) unary )*
unary = ( '+' | '-' | '~' )* 'await'? atom trailer*
trailer = '.' name | '(' args? ')' | '[' subs ']'
subs = sub ( ',' sub )* ','?
sub = '*' test | named ( ':' test? ( ':' test? )? )? | ':' test? ( ':' test? )?
args = arg ( ',' arg )* ','?
arg = '*' test | '**' test | name '=' test | named comps?
comps = ( 'async'? 'for' targets 'in' ortest ( 'if' condtest )* )+
condtest = lambda | name ':=' test | ortest
atom = num | str+ | name | '...' | '(' ( yield | ( '*' bitor | named ) ( comps | ( ',' ( '*' bitor | named ) )* ','? ) )? ')' | '[' ( ( '*' bitor | named ) ( comps | ( ',' ( '*' bitor | named ) )* ','? ) )? ']' | '{' ( dict | set )? '}'
dict = ditem comps? ( ',' ditem )* ','?
ditem = '**' bitor | test ':' test
set = ( '*' bitor | named ) ( comps | ( ',' ( '*' bitor | named ) )* ','? )
params = param ( ',' param )* ','?
param = '/' | '**' name ( ':' test )? | '*' ( name ( ':' '*'? test )? )? | name ( ':' test )? ( '=' test )?
lparams = lparam ( ',' lparam )* ','?
lparam = '/' | '**' name | '*' name? | name ( '=' test )?
pat = pat1 ( ',' pat1 )* ','?
pat1 = '*' name | pat2 ( '|' pat2 )* ( 'as' name )?
pat2 = '-'? num ( ( '+' | '-' ) num )? | str+ | dotted ( '(' ( ( name '=' )? pat1 ( ',' ( name '=' )? pat1 )* ','? )? ')' )? | '(' pat? ')' | '[' pat? ']' | '{' ( mpat ( ',' mpat )* ','? )? '}'
mpat = '**' name | ( '-'? num | str+ | dotted ) ':' pat1
"""

JSON = """
unit = value
value = str | num | const | '{' ( str ':' value ( ',' str ':' value )* )? '}' | '[' ( value ( ',' value )* )? ']'
"""

TOML = """
unit = ( '[' '['? key ']' ']'? | key '=' value )? nl
key = ( bare | val | str ) ( '.' ( bare | val | str ) )*
value = str | val | '[' nl* ( value nl* ( ',' nl* value nl* )* ( ',' nl* )? )? ']' | '{' ( key '=' value ( ',' key '=' value )* )? '}'
"""


class Language:
    """A lexer (one pattern, one token a match) and a grammar.

    ``ends``: tokens after which, at depth 0 and the end of a line, a unit is
    over; ``joins``: tokens that go on with the unit before them; ``leads``: tokens
    that, first in a line, need the next line; ``filled``: whether a file
    without any token is invalid.
    """

    def __init__(
        self, name: str, lexer: str, grammar: str, classes: tuple[str, ...], kinds: Callable[[str], str | None], operators: dict[str, str],
        ends: tuple[str, ...], joins: tuple[str, ...] = (), breaks: bool = False, filled: bool = False, leads: tuple[str, ...] = (),
    ) -> None:
        if "id" in classes:  # most of a text is blanks and names, so they are tried first; a name before a quote may be its prefix
            lexer = r"[ \t]+|[A-Za-z_]\w*+(?![\"'#`$])|" + lexer
        self.name, self.lexer, self.text, self.classes, self.kinds, self.operators = name, lexer, grammar, classes, kinds, operators
        self.ends, self.joins, self.breaks, self.filled, self.leads = ends, joins, breaks, filled, leads

    @cached_property
    def grammar(self) -> Grammar:
        return Grammar(self.text, self.classes, self.breaks)

    def char(self, token: str) -> str:
        """The character of a token's text."""
        code = self.grammar.code
        if token in ("\n", "\\\n"):
            return NEWLINE if token == "\n" else ""
        kind = self.kinds(token)
        if kind is not None:
            return "" if kind == "" else code.get(f"<{kind}>", UNKNOWN)
        name = self.operators.get(token, token)
        if name in code:
            return code[name]
        if token[0].isidentifier() or token[0] == "$":
            return code.get("<id>", UNKNOWN)
        return UNKNOWN


def _kinds(blank: str, string: str, number: str, extra: dict[str, str] | None = None) -> Callable[[str], str | None]:
    """A function from a token's text to its class, '' for what is no token, or None for words and punctuation."""
    tests = [(re.compile(blank), ""), (re.compile(string), "str"), (re.compile(number), "num"), *((re.compile(p), k) for k, p in (extra or {}).items())]
    order = [tests[0], *tests[3:], *tests[1:3]]

    def kind(token: str) -> str | None:
        for pattern, name in order:
            if pattern.fullmatch(token):
                return name
        return None

    return kind


def _words(names: str, to: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), to)


BLANK = r"[ \t\r\f]+"
IDENT = r"[^\W\d]\w*"


def _go() -> Language:
    string = rf"{STRING}|`[^`]*`|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'"
    lexer = rf"{BLANK}|\n|{LINE_COMMENT}|{BLOCK_COMMENT}|{string}|{NUMBER}i?|{IDENT}|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|:=|==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^|."
    ops = _words("<<= >>= &^= += -= *= /= %= &= |= ^=", "op=") | _words("/ % << >> &^ && || == != < <= > >=", "op")
    return Language("Go", lexer, GO, ("id", "num", "str"), _kinds(rf"{BLANK}|{LINE_COMMENT}|{BLOCK_COMMENT}", string, NUMBER + "i?"), ops, (";",), filled=True)


def _c() -> Language:
    string = rf"(?:u8|[uUL])?{STRING}|[uUL]?'(?:[^'\\\n]|\\.[0-9a-fA-F]*)+'"
    number = rf"{NUMBER}[uUlLfF]*"
    directive = r"#(?:\\\n|[^\n/]|/(?![/*])|/\*(?s:.*?)\*/)*"
    lexer = rf"{directive}|{BLANK}|\n|\\\n|{LINE_COMMENT}|{BLOCK_COMMENT}|{string}|{number}|{IDENT}|<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||[-+*/%&|^]=|==|!=|<=|>=|<<|>>|."
    ops = _words("<<= >>= += -= *= /= %= &= |= ^=", "op=") | _words("/ % << >> && || == != < <= > >= | ^", "op")
    base = r"void|char|short|int|long|float|double|signed|unsigned|_Bool|_Complex"
    qual = r"const|volatile|restrict|static|extern|inline|register|auto|_Noreturn|__inline|__restrict|_Thread_local"
    kinds = _kinds(rf"{BLANK}|{LINE_COMMENT}|{BLOCK_COMMENT}|\\\n", string, number, {"directive": r"[ \t]*#(?s:[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b.*|[ \t]*)", "base": base, "qual": qual})
    return Language("C", lexer, C, ("id", "num", "str", "directive", "base", "qual"), kinds, ops, (";", "}", "<directive>"))


def _java() -> Language:
    string = rf"\"\"\"(?s:.*?)\"\"\"|{STRING}|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|true|false|null"
    number = rf"{NUMBER}[lLfFdD]?"
    lexer = rf"{BLANK}|\n|{LINE_COMMENT}|{BLOCK_COMMENT}|{string.split('|true')[0]}|{number}|[^\W\d]\w*|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|[-+*/%&|^]=|==|!=|."
    ops = _words("<<= += -= *= /= %= &= |= ^=", "op=") | _words("/ % && || == != ^", "op")
    mods = "public|private|protected|abstract|native|transient|volatile|strictfp|sealed"
    kinds = _kinds(rf"{BLANK}|{LINE_COMMENT}|{BLOCK_COMMENT}", string, number, {"prim": "boolean|byte|short|int|long|char|float|double", "mod": mods})
    return Language("Java", lexer, JAVA, ("id", "num", "str", "prim", "mod"), kinds, ops, (";", "}"))


def _script(name: str, typed: bool) -> Language:
    text = SCRIPT + (TYPES if typed else PLAIN)
    text = text.replace("ASSERTS type | ", "")
    for mark, stands in (TYPED if typed else UNTYPED).items():
        text = text.replace(mark, stands)
    string = rf"{STRING}|'(?:[^'\\\n]|\\(?s:.))*'"
    inner = r"[^`\\$]|\\(?s:.)|\$(?!\{)"
    for _ in range(3):  # templates in templates, as deep as anyone writes them
        inner = rf"[^`\\$]|\\(?s:.)|\$(?!\{{)|\$\{{(?:[^{{}}`\"']|{string}|\{{(?:[^{{}}`]|\{{[^{{}}]*\}})*\}}|`(?:{inner})*`)*\}}"
    template = rf"`(?:{inner})*`"
    before = r"(?:(?<=[(,=:\[!&|?{};\n>+])|(?<=[(,=:\[!&|?{};>+] )|(?<=return ))"
    regex = before + r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    number = rf"{NUMBER}n?"
    close = r"" if typed else r"|>>>?"
    lexer = rf"{BLANK}|\n|{LINE_COMMENT}|{BLOCK_COMMENT}|{string}|{template}|{regex}|{number}|[^\W\d]\w*|\$[\w$]*|=>|\.\.\.|\?\.(?!\d)|>>>=|>>=|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|\*\*|\+\+|--|&&|\|\||\?\?|[-+*/%&|^]=|==|!=|<=|>=|<<{close}|."
    ops = _words(">>>= >>= **= <<= &&= ||= ??= += -= *= /= %= &= |= ^=", "op=") | _words("/ % ** << >> >>> && || ?? == != === !== <= >= ^", "op")
    kinds = _kinds(rf"{BLANK}|{LINE_COMMENT}|{BLOCK_COMMENT}", string, number, {"template": template, "regex": r"/(?s:.+)/[a-z]*"})
    lexer = lexer.replace(r"[^\W\d]\w*|\$[\w$]*", r"(?:[^\W\d]|\$)[\w$]*")
    return Language(name, lexer, text, ("id", "num", "str", "template", "regex", "never"), kinds, ops, (";", "}"), ("else", "catch", "finally", "while", ".", "?.", ",", ":", "?", "op", "=", "=>", "op=", "&", "|", "*", ">"), breaks=True)


def _rust() -> Language:
    string = rf"b?r#\"(?s:.*?)\"#|b?r##\"(?s:.*?)\"##|b?r\"[^\"]*\"|[bc]?\"(?:[^\"\\]|\\(?s:.))*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'|true|false"
    number = rf"{NUMBER}(?:[iuf](?:8|16|32|64|128|size))?"
    block = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?s:.*?)\*/)*\*/)*\*/"
    lexer = rf"{BLANK}|\n|{LINE_COMMENT}|{block}|{string.split('|true')[0]}|{number}|'[^\W\d]\w*|r#[^\W\d]\w*|[^\W\d]\w*|<<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||[-+*/%&|^]=|==|!=|."
    ops = _words("<<= >>= += -= *= /= %= &= |= ^=", "op=") | _words("/ % == != ^", "op") | {"..=": "..", "...": ".."}
    kinds = _kinds(rf"{BLANK}|{LINE_COMMENT}|{block}", string, number, {"life": r"'[^\W\d]\w*"})
    return Language("Rust", lexer, RUST, ("id", "num", "str", "life"), kinds, ops, (";", "}"))


def _python() -> Language:
    prefix = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
    string = rf"{prefix}\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"|{prefix}'''(?:[^\\]|\\(?s:.))*?'''|{prefix}\"(?:[^\"\\\n]|\\(?s:.))*\"|{prefix}'(?:[^'\\\n]|\\(?s:.))*'|True|False|None"
    number = rf"{NUMBER}[jJ]?"
    lexer = rf"[ \t\f]+|\n|\\\n|#[^\n]*|{string.split('|True')[0]}|{number}|[^\W\d]\w*|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|[-+*/%&|^@]=|\*\*|//|>>|<<|==|!=|<=|>=|."
    ops = _words("**= //= >>= <<= += -= *= /= %= &= |= ^= @=", "op=") | _words("// % >> << & | ^ /", "op") | _words("== != <= >= < >", "cmp")
    kinds = _kinds(r"[ \t\f]+|#[^\n]*|\\\n", string, number)
    text = PYTHON.replace("'/' |", "'op' |").replace("( '|' pat2 )", "( 'op' pat2 )")
    return Language("Python", lexer, text, ("id", "num", "str", "nl", "indent", "dedent"), kinds, ops, ("<nl>", "<dedent>"), ("<indent>", "elif", "else", "except", "finally"), leads=("@",))


def _json() -> Language:
    string = r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\""
    number = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
    return Language("JSON", rf"[ \t\r\n]+|{string}|{number}|[A-Za-z_]\w*|(?s:.)", JSON, ("str", "num", "const"), _kinds(r"[ \t\r\n]+", string, number, {"const": "true|false|null"}), {}, (), filled=True)


def _toml() -> Language:
    string = r"\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"\"{0,2}|'''(?s:.*?)''''{0,2}|\"(?:[^\"\\\n]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'[^'\n]*'"
    whole = r"(?:0|[1-9](?:_?\d)*)"
    date, clock = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d(?:\.\d+)?"
    value = rf"{date}(?:[Tt ]{clock}(?:[Zz]|[+-]\d\d:\d\d)?)?|{clock}|[+-]?(?:inf|nan|{whole}(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w-])|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|(?:true|false)(?![\w-])"
    bare = r"[A-Za-z0-9_-]+"
    return Language("TOML", rf"[ \t]+|\r?\n|#[^\n]*|{string}|{value}|{bare}|.", TOML, ("str", "val", "bare", "nl"), _kinds(r"[ \t]+|#[^\n]*", string, r"\Z.", {"val": value, "bare": bare}), {}, ("<nl>",))


LANGUAGES = {x.name: x for x in (_python(), _go(), _script("JavaScript", False), _script("TypeScript", True), _java(), _rust(), _c(), _json(), _toml())}
#: The language that a file's extension names (fixed values).
EXTENSIONS = {
    "py": "Python", "go": "Go", "js": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript",
    "java": "Java", "rs": "Rust", "c": "C", "json": "JSON", "toml": "TOML", "md": "Markdown",
}
