"""Grammars and lexers of the six languages, as data.

A lexer is one regular expression over the text. What a token is follows from its own text:
keywords and operators stand for themselves, all else by its first characters. Expression
operators are flat (``unary (operator unary)*``), which accepts the same token streams as
a ladder of precedences, so that whether a file is valid does not depend on the tree.
"""

from __future__ import annotations

JS_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false await yield let "
    "async of get set static from as"
).split()
TS_WORDS = (
    "type interface declare readonly abstract namespace module public private protected override keyof infer is satisfies "
    "unique asserts implements"
).split()

_JS = """
program : HASHBANG? item* ;
item : stmt | decl | import_ | export_ ;
id : ID | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'yield' %SOFT% ;
kw : 'break'|'case'|'catch'|'class'|'const'|'continue'|'debugger'|'default'|'delete'|'do'|'else'|'enum'|'export'|'extends'|'finally'|'for'
   |'function'|'if'|'import'|'in'|'instanceof'|'new'|'return'|'super'|'switch'|'this'|'throw'|'try'|'typeof'|'var'|'void'|'while'|'with'
   |'null'|'true'|'false'|'await' ;
name : id | kw ;
block : '{' item* '}' ;
stmt : block | 'SEMI' | exprs_S 'SEMI' | 'if' '(' exprs ')' stmt | 'if' '(' exprs ')' stmt 'else' stmt
     | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' exprs ')' stmt | 'with' '(' exprs ')' stmt
     | 'do' stmt 'while' '(' exprs ')' 'SEMI'? | 'return' exprs? 'SEMI' | 'throw' exprs 'SEMI' | 'break' id? 'SEMI' | 'continue' id? 'SEMI'
     | 'switch' '(' exprs ')' '{' case* '}' | 'try' block catch? ('finally' block)? | id ':' stmt | 'debugger' 'SEMI' ;
case : 'case' exprs ':' item* | 'default' ':' item* ;
catch : 'catch' block | 'catch' '(' pattern %TYPEOPT% ')' block ;
forhead : forinit? 'SEMI' exprs? 'SEMI' exprs? | ('var'|'let'|'const')? pattern ('of'|'in') exprs | exprs ('of'|'in') exprs ;
forinit : exprs | ('var'|'let'|'const') declarator (',' declarator)* ;
decl : ('var'|'let'|'const') declarator (',' declarator)* 'SEMI' | function | class %TSDECL% ;
declarator : pattern %BANG% %TYPEOPT% ('=' expr)? ;
pattern : id | '{' (patprop (',' patprop)* ','?)? '}' | '[' patelem (',' patelem)* ']' ;
patprop : id ('=' expr)? | propname ':' pattern ('=' expr)? | '...' pattern ;
patelem : (pattern ('=' expr)? | '...' pattern)? ;
function : 'async'? 'function' '*'? id? %TPARAMS% params %RETTYPE% block %SIGNATURE% ;
params : '(' (param (',' param)* ','?)? ')' ;
param : decorator* %MODS% '...'? (pattern | 'this') %OPTMARK% %TYPEOPT% ('=' expr)? ;
class : decorator* %ABSTRACT% 'class' id? %TPARAMS% ('extends' postfix_E %TARGSOPT%)? %IMPLEMENTS% '{' member* '}' ;
decorator : '@' postfix_E ;
mod : 'static' | 'async' | 'get' | 'set' | '*' %MOD% ;
member : 'SEMI' | decorator* mod* propname %OPTMARK% %TPARAMS% params %RETTYPE% (block %MEMBEREND%)
       | decorator* mod* propname %OPTBANG% %TYPEOPT% ('=' expr)? 'SEMI' | 'static' block %INDEXSIG% ;
propname : name | STR | NUM | TPL | HASHID | '[' expr ']' ;
import_ : 'import' %TYPEWORD% importclause 'from' STR importattrs? 'SEMI' | 'import' STR importattrs? 'SEMI' %IMPORTEQ% ;
importattrs : ('with'|ID) object ;
importclause : id | id ',' named | id ',' '*' 'as' id | named | '*' 'as' id ;
named : '{' (spec (',' spec)* ','?)? '}' ;
spec : %TYPEWORD% (name | STR) ('as' (name | STR))? ;
export_ : 'export' decl | 'export' 'default' (function | class | expr_S 'SEMI' | object suffix* %ASSERT% 'SEMI' %EXPORTDEF%) | 'export' %TYPEWORD% named ('from' STR importattrs?)? 'SEMI'
        | 'export' %TYPEWORD% '*' ('as' (name|STR))? 'from' STR 'SEMI' %EXPORTEQ% ;
exprs : expr (',' expr)* ;
exprs_S : expr_S (',' expr)* ;
expr : tern_E %ASSERT% ;
expr_S : tern_S %ASSERT% ;
tern_E : bin_E | bin_E '?' expr ':' expr ;
tern_S : bin_S | bin_S '?' expr ':' expr ;
bin_E : unary_E (binop unary_E)* ;
bin_S : unary_S (binop unary_E)* ;
binop : BINOP | '=' | '>' | '>' '>' | '>' '>' '>' | '<' | '*' | '-' | '+' | '&' | '|' | 'in' | 'instanceof' | '>=' | '>' '>=' | '>' '>' '>=' ;
unary_E : postfix_E INCDEC? | prefix unary_E | arrow | 'yield' '*'? unary_E ;
unary_S : postfix_S INCDEC? | prefix unary_E | arrow | 'yield' '*'? unary_E ;
prefix : '!' | '~' | '+' | '-' | INCDEC | PREINC | 'typeof' | 'void' | 'delete' | 'await' ;
arrow : 'async'? id '=>' arrowbody | 'async'? paren %RETTYPE% '=>' arrowbody %GENARROW% ;
arrowbody : block | expr_S ;
postfix_E : primary_S suffix* | object suffix* | funcexpr suffix* ;
postfix_S : primary_S suffix* ;
funcexpr : function | class ;
suffix : '.' name | '.' HASHID | '?.' name | '?.' paren | '?.' '[' exprs ']' | '[' exprs ']' | paren | TPL %SUFFIX% ;
primary_S : id | NUM | STR | TPL | REGEX | HASHID | 'this' | 'super' | 'null' | 'true' | 'false' | paren | array | 'import' paren | 'import' '.' name
          | 'new' newtarget | 'new' '.' name ;
newtarget : newbase newsuffix* %NEWARGS% ;
newbase : id | 'this' | 'super' | paren | array | funcexpr | 'new' newtarget | 'import' '.' name ;
newsuffix : '.' name | '[' exprs ']' | paren ;
paren : '(' (arg (',' arg)* ','?)? ')' ;
arg : '...'? expr %ARGTYPE% ;
array : '[' elem (',' elem)* ']' ;
elem : ('...'? expr)? ;
object : '{' (prop (',' prop)* ','?)? '}' ;
prop : propname ':' expr | id | id '=' expr | '...' expr | propmod* propname %TPARAMS% params %RETTYPE% block ;
propmod : 'get' | 'set' | 'async' | '*' ;
"""

_TS = """
type : union | union 'extends' union '?' type ':' type | functype | ('asserts')? (id | 'this') 'is' type | 'asserts' id ;
functype : 'abstract'? 'new'? tparams? params '=>' type ;
union : ('|' | '&')? tprim (('|' | '&') tprim)* ;
tprim : ('keyof' | 'readonly' | 'unique' | 'infer')* tatom tsuffix* ;
tsuffix : '[' type? ']' ;
tatom : tname targs? | STR | NUM | TPL | '-' NUM | 'null' | 'void' | 'this' | 'true' | 'false' | '{' tmember* '}'
      | '[' (telem (',' telem)* ','?)? ']' | '(' type ')' | 'typeof' tname targs? | ('typeof')? 'import' '(' STR ')' ('.' name)* targs? ;
tname : id ('.' name)* ;
telem : '...'? type '?'? | '...'? id '?'? ':' type ;
tmember : tmods propname '?'? (':' type)? tend | tmods propname '?'? tparams? params (':' type)? tend | 'new'? tparams? params (':' type)? tend
        | tmods '[' id ':' type ']' ':' type tend | '-'? '+'? tmods '[' id 'in' type ('as' type)? ']' ('-' | '+')? '?'? (':' type)? tend ;
tmods : ('readonly' | 'get' | 'set' | '-' 'readonly' | '+' 'readonly')? ;
tend : 'SEMI' | ',' | ;
targs : '<' type (',' type)* '>' ;
tparams : '<' tparam (',' tparam)* ','? '>' ;
tparam : 'const'? id ('extends' type)? ('=' type)? ;
tsdecl : 'interface' id tparams? ('extends' ref (',' ref)*)? '{' tmember* '}' | 'type' id tparams? '=' type 'SEMI'
       | 'const'? 'enum' id '{' (enumitem (',' enumitem)* ','?)? '}' | ('namespace' | 'module') (id ('.' id)* | STR) block | 'declare' decl
       | 'declare' 'module' STR 'SEMI' ;
enumitem : propname ('=' expr)? ;
ref : tname targs? ;
"""

_PLAIN = {
    "SOFT": "", "TYPEOPT": "", "TSDECL": "", "BANG": "", "TPARAMS": "", "RETTYPE": "", "SIGNATURE": "", "MODS": "", "OPTMARK": "", "ABSTRACT": "",
    "TARGSOPT": "", "IMPLEMENTS": "", "MOD": "", "MEMBEREND": "", "OPTBANG": "", "INDEXSIG": "", "TYPEWORD": "", "IMPORTEQ": "", "EXPORTDEF": "",
    "EXPORTEQ": "", "ASSERT": "", "GENARROW": "", "SUFFIX": "", "NEWARGS": "", "ARGTYPE": "",
}
_TYPED = {
    "SOFT": "".join(f"| '{w}'" for w in TS_WORDS), "TYPEOPT": "(':' type)?", "TSDECL": "| tsdecl", "BANG": "'!'?", "TPARAMS": "tparams?",
    "RETTYPE": "(':' type)?", "SIGNATURE": "| 'async'? 'function' '*'? id tparams? params (':' type)? 'SEMI'",
    "MODS": "('public' | 'private' | 'protected' | 'readonly' | 'override')*", "OPTMARK": "'?'?", "ABSTRACT": "'abstract'?", "TARGSOPT": "targs?",
    "IMPLEMENTS": "('implements' ref (',' ref)*)?", "MOD": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override'",
    "MEMBEREND": "| 'SEMI'", "OPTBANG": "('?' | '!')?", "INDEXSIG": "| mod* '[' id ':' type ']' ':' type 'SEMI'", "TYPEWORD": "'type'?",
    "IMPORTEQ": "| 'import' id '=' exprs 'SEMI'", "EXPORTDEF": "| tsdecl", "EXPORTEQ": "| 'export' '=' expr 'SEMI' | 'export' 'as' 'namespace' id 'SEMI'",
    "ASSERT": "(('as' | 'satisfies') (type | 'const'))*", "GENARROW": "| 'async'? tparams paren (':' type)? '=>' arrowbody",
    "SUFFIX": "| '!' | targs paren", "NEWARGS": "(targs paren?)? suffix0*", "ARGTYPE": "| '...'? bin_E '?'? ':' type ('=' expr)? | ('public' | 'private' | 'protected' | 'readonly') id '?'? ':' type ('=' expr)?",
}


def javascript(typed: bool) -> str:
    text = _JS + (_TS + "suffix0 : '.' name | '[' exprs ']' | paren ;" if typed else "")
    for k, v in (_TYPED if typed else _PLAIN).items():
        text = text.replace(f"%{k}%", v)
    return text


PY_WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield match case type"
).split()
PYTHON = """
program : (NEWLINE | stmt)* ;
stmt : simple (';' simple)* ';'? NEWLINE | compound ;
id : ID | 'match' | 'case' | 'type' ;
simple : starlist | starlist (':' expr)? '=' assigned | starlist ':' expr | starlist AUG (starlist | yield_) | yield_ | 'pass' | 'break' | 'continue' | 'return' starlist?
       | 'raise' (expr ('from' expr)?)? | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'del' starlist | 'assert' expr (',' expr)? | import_
       | 'type' id tparams? '=' expr ;
assigned : starlist | yield_ | starlist '=' assigned ;
yield_ : 'yield' starlist? | 'yield' 'from' expr ;
import_ : 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')') ;
dotted : id ('.' id)* ;
names : id ('as' id)? (',' id ('as' id)?)* ;
suite : simple (';' simple)* ';'? NEWLINE | NEWLINE+ INDENT (NEWLINE | stmt)+ DEDENT ;
compound : 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)?
         | 'async'? 'for' starlist 'in' starlist ':' suite ('else' ':' suite)? | 'try' ':' suite except+ ('else' ':' suite)? ('finally' ':' suite)?
         | 'try' ':' suite 'finally' ':' suite | 'async'? 'with' withitems ':' suite | def_ | class_ | ('@' named NEWLINE)+ (def_ | class_)
         | 'match' starlist ':' NEWLINE+ INDENT (NEWLINE | 'case' pattern ('if' named)? ':' suite)+ DEDENT ;
pattern : starlist | starlist 'as' id ;
except : 'except' '*'? (starlist ('as' id)?)? ':' suite ;
withitems : withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')' ;
withitem : expr ('as' postfix)? ;
def_ : 'async'? 'def' id tparams? '(' params ')' ('->' expr)? ':' suite ;
tparams : '[' tparam (',' tparam)* ','? ']' ;
tparam : ('*' | '**')? id (':' expr)? ('=' expr)? ;
params : (param (',' param)* ','?)? ;
param : id (':' expr)? ('=' expr)? | '*' (id (':' ('*')? expr)?)? | '**' id (':' expr)? | '/' ;
lparams : (lparam (',' lparam)* ','?)? ;
lparam : id ('=' expr)? | '*' id? | '**' id | '/' ;
class_ : 'class' id tparams? ('(' args ')')? ':' suite ;
starlist : star (',' star)* ','? ;
star : named | '*' bin ;
named : expr | id ':=' expr ;
expr : bin | bin 'if' bin 'else' expr | 'lambda' lparams ':' expr ;
bin : unary (binop unary)* ;
binop : BINOP | '*' | '**' | '-' | '+' | '/' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '@' ;
unary : postfix | '-' unary | '+' unary | '~' unary | 'not' unary | 'await' unary ;
postfix : atom suffix* ;
suffix : '.' id | '(' args ')' | '[' subscript (',' subscript)* ','? ']' ;
subscript : star | expr? ':' expr? (':' expr?)? ;
args : (arg (',' arg)* ','?)? ;
arg : named | named comp+ | id '=' expr | '*' expr | '**' expr ;
comp : 'async'? 'for' targets 'in' bin1 ('if' bin1)* ;
targets : postfix_t (',' postfix_t)* ','? ;
postfix_t : postfix | '*' postfix ;
bin1 : bin | bin 'if' bin 'else' expr | 'lambda' lparams ':' expr | id ':=' expr ;
atom : id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' starlist ')' | '(' named comp+ ')' | '(' yield_ ')' | '[' ']' | '[' starlist ']'
     | '[' star comp+ ']' | '{' '}' | '{' dictitem (',' dictitem)* ','? '}' | '{' dictitem comp+ '}' | '{' starlist '}' | '{' star comp+ '}' ;
dictitem : expr ':' expr | '**' bin ;
"""

GO_WORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct "
    "switch type var"
).split()
_GO_EXPR = """
expr_X : unary_X (binop unary_X)* ;
unary_X : primary_X | ('-' | '+' | '*' | '&' | '^' | '!' | '<-' | '~') unary_X ;
primary_X : operand_X suffix* ;
operand_X : NUM | STR | RUNE | ID | '(' (expr | typeonly) ')' | func funcbody_X | typelit_X ;
"""
_GO = """
program : 'package' ID ';' (import_ ';')* (top ';')* ;
import_ : 'import' (importspec | '(' (importspec ';')* importspec? ')') ;
importspec : ('.' | ID)? STR ;
top : decl | 'func' ID tparams? signature block? | 'func' params ID signature block? ;
decl : 'const' (constspec | '(' (constspec ';')* constspec? ')') | 'var' (varspec | '(' (varspec ';')* varspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')') ;
constspec : ids type? ('=' exprs)? ;
varspec : ids type ('=' exprs)? | ids '=' exprs ;
typespec : ID tparams? '='? type ;
tparams : '[' ids type1 (',' ids type1)* ','? ']' ;
type1 : tterm ('|' tterm)* ;
tterm : '~'? type ;
ids : ID (',' ID)* ;
exprs : expr (',' expr)* ;
typename : ID | ID '.' ID ;
type : typename | typename '[' type (',' type)* ','? ']' | typeonly | '(' type ')' ;
typeonly : '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | func | structtype | interfacetype ;
func : 'func' signature ;
structtype : 'struct' '{' (field ';')* field? '}' ;
field : (ids type | '*'? typename ('[' type (',' type)* ']')?) STR? ;
interfacetype : 'interface' '{' (imember ';')* imember? '}' ;
imember : ID signature | type1 ;
signature : params result? ;
result : params | type ;
params : '(' (param (',' param)* ','?)? ')' ;
param : type | ID '...'? type | '...' type ;
block : '{' stmts '}' ;
stmts : (stmt? ';')* stmt? ;
stmt : decl | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if_ | for_ | switch_ | select_ | ID ':' stmt? ;
simple : exprs | exprs INCDEC | exprs ASSIGN rhs | exprs '=' rhs | expr '<-' expr ;
rhs : exprs | 'range' expr ;
simple_X : exprs_X | exprs_X INCDEC | exprs_X ASSIGN exprs_X | exprs_X '=' exprs_X | expr_X '<-' expr_X ;
exprs_X : expr_X (',' expr_X)* ;
if_ : 'if' simple_X block else_? | 'if' simple_X? ';' simple_X block else_? ;
else_ : 'else' (if_ | block) ;
for_ : 'for' block | 'for' simple_X block | 'for' simple_X? ';' simple_X? ';' simple_X? block | 'for' (exprs_X (ASSIGN | '='))? 'range' expr_X block ;
switch_ : 'switch' (simple_X? ';')? simple_X? '{' case* '}' ;
case : ('case' caselist | 'default') ':' stmts ;
caselist : (expr | typeonly) (',' (expr | typeonly))* ;
select_ : 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
expr : unary (binop unary)* ;
unary : primary | ('-' | '+' | '*' | '&' | '^' | '!' | '<-' | '~') unary ;
primary : operand suffix* ;
operand : NUM | STR | RUNE | ID | ID composite | ID '.' ID composite | '(' (expr | typeonly) ')' | func block | typelit ;
typelit : '[' ']' type composite? | '[' (expr | '...') ']' type composite? | 'map' '[' type ']' type composite? | 'chan' type | structtype composite? | interfacetype ;
suffix : '.' ID | '.' '(' (type | 'type') ')' | '(' args ')' | '[' index ']' | generic ;
generic : '[' type (',' type)* ','? ']' composite ;
index : (expr | typeonly) (',' (expr | typeonly))* ','? | expr? ':' expr? (':' expr)? ;
args : ((expr | typeonly) (',' (expr | typeonly))* '...'? ','?)? ;
composite : '{' (celem (',' celem)* ','?)? '}' ;
celem : cval (':' cval)? ;
cval : expr | composite ;
binop : BINOP | '*' | '&' | '-' | '+' | '^' | '<-' | '|' ;
"""


def go() -> str:
    head = _GO_EXPR.replace("func funcbody_X", "func block").replace("typelit_X", "typelit")
    return _GO + head


RS_WORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
    "static struct super trait true type unsafe use where while union"
).split()
_RS_EXPR = """
expr_X : range_X ;
range_X : bin_X | bin_X '..' bin_X? | '..' bin_X? ;
bin_X : unary_X (binop unary_X)* ;
unary_X : postfix_X ('as' type)* | ('-' | '!' | '*') unary_X | ('&' | '&&') 'mut'? unary_X | jump_X | closure_X ;
jump_X : 'return' expr_X? | 'break' LIFETIME? expr_X? | 'continue' LIFETIME? ;
closure_X : 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') (expr_X | '->' type block) ;
postfix_X : primary_X suffix* ;
primary_X : NUM | STR | CHAR | 'true' | 'false' | path_e | macro | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' %STRUCT_X% | blocklike ;
"""
_RS = """
program : INNER* item* ;
attr : OUTER '[' tts ']' ;
inner : OUTER '!' '[' tts ']' ;
item : attr* vis (fn | struct | enum | impl | trait | mod | use | const | typealias | externblock | macroitem) | inner ;
vis : ('pub' ('(' ('crate' | 'super' | 'self' | 'in' path) ')')?)? ;
use : 'use' usetree ';' ;
usetree : '::'? useseg ('::' useseg)* ('as' ID)? ;
useseg : ID | 'self' | 'super' | 'crate' | '*' | '{' (usetree (',' usetree)* ','?)? '}' ;
mod : 'unsafe'? 'mod' ID (';' | '{' item* '}') ;
const : ('const' | 'static') 'mut'? ID ':' type ('=' expr)? ';' ;
typealias : 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' ;
externblock : 'unsafe'? 'extern' STR? '{' item* '}' | 'extern' 'crate' ID ('as' ID)? ';' ;
macroitem : path '!' ID? (('(' tts ')' | '[' tts ']') ';' | '{' tts '}') ;
fnmods : ('const' | 'async' | 'unsafe' | 'extern' STR?)* ;
fn : fnmods 'fn' ID generics? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where? (block | ';') ;
fparam : attr* (pattern ':' type | 'mut'? 'self' (':' type)? | '&' LIFETIME? 'mut'? 'self' | '...') ;
generics : '<' (gparam (',' gparam)* ','?)? '>' ;
gparam : LIFETIME (':' bounds)? | ID (':' bounds)? ('=' type)? | 'const' ID ':' type ('=' expr)? ;
bounds : (bound ('+' bound)* '+'?)? ;
bound : LIFETIME | '?'? ('for' generics)? path | '(' '?'? path ')' ;
where : 'where' (wpred (',' wpred)* ','?)? ;
wpred : ('for' generics)? type ':' bounds | LIFETIME ':' bounds ;
struct : ('struct' | 'union') ID generics? where? ('{' (sfield (',' sfield)* ','?)? '}' | ';' | '(' (tfield (',' tfield)* ','?)? ')' where? ';') ;
sfield : attr* vis ID ':' type ;
tfield : attr* vis type ;
enum : 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant : attr* vis ID ('{' (sfield (',' sfield)* ','?)? '}' | '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)? ;
impl : 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' item* '}' ;
trait : 'unsafe'? 'trait' ID generics? (':' bounds)? where? '{' item* '}' ;
type : path | '&' LIFETIME? 'mut'? type | '&&' LIFETIME? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | '!'
     | ('for' generics)? fnmods 'fn' '(' (ftype (',' ftype)* ','?)? ')' ('->' type)? | ('dyn' | 'impl') bounds | qpath | path '!' '(' tts ')' ;
ftype : (ID ':')? type | '...' ;
qpath : '<' type ('as' path)? '>' '::' path ;
path : '::'? pathseg ('::' pathseg)* ;
pathseg : pname | pname targs | pname '::' targs | pname '(' (type (',' type)* ','?)? ')' ('->' type)? ;
pname : ID | 'self' | 'Self' | 'super' | 'crate' ;
targs : '<' (targ (',' targ)* ','?)? '>' ;
targ : LIFETIME | type | NUM | STR | 'true' | 'false' | block | ID '=' type | ID ':' bounds | '-' NUM ;
path_e : '::'? eseg ('::' eseg)* | qpath ('::' eseg)* ;
eseg : pname | targs ;
block : '{' INNER* stmt* blockend? '}' ;
blockend : attr* expr ;
stmt : ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocklike | attr* macrobrace ;
blocklike : 'unsafe'? block | 'async' 'move'? block | 'const' block | if_ | (LIFETIME ':')? ('while' cond block | 'loop' block | 'for' pattern 'in' expr_H block | block) | match ;
if_ : 'if' cond block ('else' (if_ | block))? ;
cond : condpart ('&&' condpart)* ;
condpart : expr_H | 'let' pattern '=' expr_H ;
match : 'match' expr_H '{' (arm)* lastarm? '}' ;
arm : attr* pattern ('if' cond_E)? '=>' (expr ',' | blocklike ','?) ;
lastarm : attr* pattern ('if' cond_E)? '=>' expr ;
cond_E : expr | 'let' pattern '=' expr ;
macro : path_e '!' ('(' tts ')' | '[' tts ']' | '{' tts '}') ;
macrobrace : path_e '!' '{' tts '}' ;
tts : tt* ;
tt : '(' tts ')' | '[' tts ']' | '{' tts '}' | ANYTT ;
cparam : pattern1 (':' type)? ;
suffix : '.' ID | '.' NUM | '.' 'await' | '.' ID '::' targs | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?' ;
pattern : '|'? pattern1 ('|' pattern1)* ;
pattern1 : 'ref'? 'mut'? ID ('@' pattern1)? | lit (('..') lit?)? | '..' lit? | path_p | path_p '(' (pattern (',' pattern)* ','?)? ')' | path_p '{' (fpat (',' fpat)* ','?)? '}'
         | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | ('&' | '&&') 'mut'? pattern1 | macro ;
path_p : '::'? pname '::' pname ('::' pname)* | pname targs2 | 'Self' | ID ;
targs2 : '::' targs ('::' pname)* ;
fpat : attr* (ID ':' pattern | NUM ':' pattern | 'ref'? 'mut'? ID | '..') ;
lit : '-'? NUM | STR | CHAR | 'true' | 'false' | path_p ;
binop : BINOP | '=' | '<' | '>' | '>' '>' | '>=' | '>' '>=' | '&' | '|' | '&&' | '||' | '*' | '-' | '+' ;
structfields : '{' (sinit (',' sinit)* ','?)? ('..' expr)? '}' ;
sinit : attr* ((ID | NUM) ':' expr | ID) | '..' expr ;
"""


def rust() -> str:
    words = [*RS_WORDS]
    anytt = " | ".join(f"'{w}'" for w in words) + (
        " | ID | NUM | STR | CHAR | LIFETIME | BINOP | OUTER | '=' | '<' | '>' | '>=' | '&' | '|' | '&&' | '||' | '*' | '-' | '+' | '!' | '?' | ',' | ';' | ':' | '::'"
        " | '.' | '..' | '...' | '->' | '=>' | '@' | '$' | '~'"
    )
    full = _RS_EXPR.replace("%STRUCT_X%", "| path_e structfields").replace("_X", "")
    header = _RS_EXPR.replace("%STRUCT_X%", "").replace("_X", "_H")
    return _RS.replace("ANYTT", anytt) + full + header


DART_WORDS = (
    "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends "
    "extension external factory false final finally for get hide if implements import in interface is late library mixin new null of on operator "
    "part required rethrow return sealed set show static super switch sync this throw true try typedef var void when while with yield Function"
).split()
DART = """
program : HASHBANG? directive* top* ;
id : ID | 'abstract' | 'as' | 'async' | 'base' | 'covariant' | 'deferred' | 'dynamic' | 'extension' | 'external' | 'factory' | 'get' | 'hide' | 'implements'
   | 'interface' | 'late' | 'mixin' | 'of' | 'on' | 'operator' | 'required' | 'sealed' | 'set' | 'show' | 'static' | 'sync' | 'when' | 'Function' | 'await' | 'yield' ;
meta : '@' id ('.' id)* targs? args? ;
directive : meta* ('library' (id ('.' id)*)? ';' | ('import' | 'export') STR+ ('if' '(' id ('.' id)* ('==' STR)? ')' STR)* ('deferred'? 'as' id)? (('show' | 'hide') id (',' id)*)* ';'
          | 'part' ('of' id ('.' id)* | 'of'? STR) ';') ;
top : meta* (class | mixin_ | extension_ | enum | typedef_ | 'external'? func funcend | vardecl ';' | getset funcend) ;
classmod : 'abstract' | 'base' | 'interface' | 'final' | 'sealed' | 'mixin' ;
class : classmod* 'class' id tparams? ('extends' type)? ('with' types)? ('implements' types)? ('{' (meta* member)* '}') | classmod* 'class' id tparams? '=' type ('with' types)? ('implements' types)? ';' ;
mixin_ : 'base'? 'mixin' id tparams? ('on' types)? ('implements' types)? '{' (meta* member)* '}' ;
extension_ : 'extension' ('type' 'const'?)? id? tparams? ('(' params0 ')')? ('on' type)? ('implements' types)? '{' (meta* member)* '}' ;
enum : 'enum' id tparams? ('with' types)? ('implements' types)? '{' enumitem (',' enumitem)* ','? (';' (meta* member)*)? '}' ;
enumitem : meta* id targs? ('.' id)? args? ;
typedef_ : 'typedef' id tparams? '=' type ';' | 'typedef' type? id tparams? params ';' ;
types : type (',' type)* ;
type : tbase '?'? | tbase0? 'Function' tparams? params '?'? | type 'Function' tparams? params '?'? | '(' (rectype (',' rectype)* ','?)? ')' '?'? ;
tbase0 : 'void' ;
tbase : 'void' | id targs? | id '.' id targs? ;
rectype : meta* type id? | '{' (type id (',' type id)* ','?)? '}' ;
targs : '<' type (',' type)* '>' ;
tparams : '<' (meta* id ('extends' type)?) (',' meta* id ('extends' type)?)* '>' ;
func : type? id tparams? params ;
getset : 'external'? 'static'? type? 'get' id | 'external'? 'static'? type? 'set' id params ;
funcend : ('async' '*'? | 'sync' '*')? (block | '=>' expr ';') | ';' ;
params : '(' params0 ')' ;
params0 : (param (',' param)* (',' optparams)? ','?)? | optparams ;
optparams : '[' param (',' param)* ','? ']' | '{' param (',' param)* ','? '}' ;
param : meta* ('required' | 'covariant' | 'final' | 'const' | 'late' | 'var')* (type? (('this' | 'super') '.')? id tparams? params? '?'? | type) (('=' | ':') expr)? ;
member : mods func initializers? funcend | mods id '.' id params initializers? funcend | mods id '.' 'new' params initializers? funcend
       | mods id ('.' (id | 'new'))? params '=' type ('.' id)? ';' | getset funcend | mods type? 'operator' operator params funcend | mods vardecl ';' ;
mods : ('external' | 'static' | 'const' | 'factory' | 'covariant' | 'abstract')* ;
operator : BINOP | '==' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '*' | '-' | '+' | '&' | '|' | '~' | '[' ']' | '[' ']' '=' ;
initializers : ':' initializer (',' initializer)* ;
initializer : ('this' '.')? id '=' expr | 'super' ('.' id)? args | 'this' ('.' id)? args | 'assert' args ;
vardecl : ('late' | 'final' | 'const' | 'var')+ type? declarator (',' declarator)* | type declarator (',' declarator)* ;
declarator : id ('=' expr)? ;
block : '{' stmt* '}' ;
stmt : block | ';' | meta* vardecl ';' | 'await'? expr_S ';' | meta* func ('async' '*'? | 'sync' '*')? (block | '=>' expr ';') | 'if' '(' expr ('case' pattern ('when' expr)?)? ')' stmt ('else' stmt)?
     | 'await'? 'for' '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';'
     | 'switch' '(' expr ')' '{' case* '}' | 'try' block catch* ('finally' block)? | 'rethrow' ';' | 'assert' args ';' | 'yield' '*'? expr ';' | id ':' stmt
     | ('final' | 'var') pattern '=' expr ';' ;
forhead : (vardecl | exprs)? ';' expr? ';' exprs? | ('final' | 'var' | 'const' | 'late')* (type? id | pattern) 'in' expr ;
exprs : expr (',' expr)* ;
case : (id ':')* ('case' pattern ('when' expr)? | 'default') ':' stmt* ;
catch : 'on' type ('catch' '(' id (',' id)? ')')? block | 'catch' '(' id (',' id)? ')' block ;
pattern : expr | ('final' | 'var') type? id | pattern ('|' '|' | BINOP) pattern ;
expr : bin | bin '?' expr ':' expr | 'throw' expr | closure ;
expr_S : bin_S | bin_S '?' expr ':' expr | 'throw' expr ;
closure : tparams? params ('async' '*'? | 'sync' '*')? ('=>' expr | block) ;
bin : unary (binop unary | ('is' '!'?| 'as') type)* (assignop expr)? cascade* ;
bin_S : unary_S (binop unary | ('is' '!'? | 'as') type)* (assignop expr)? cascade* ;
binop : BINOP | '==' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '*' | '-' | '+' | '&' | '|' ;
assignop : '=' | ASSIGN | '>' '>=' ;
cascade : ('..' | '?..') (id | '[' expr ']') suffix* (assignop expr)? ;
unary : postfix INCDEC? | ('-' | '!' | '~' | 'await' | INCDEC) unary ;
unary_S : postfix_S INCDEC? | ('-' | '!' | '~' | INCDEC) unary ;
postfix : primary suffix* ;
postfix_S : primary_S suffix* ;
suffix : '.' (id | 'new') | '?.' id | '[' expr ']' | '?' '[' expr ']' | args | targs args | '!' ;
args : '(' (arg (',' arg)* ','?)? ')' ;
arg : expr | id ':' expr ;
primary : primary_S | collection ;
primary_S : id | NUM | STR+ | 'this' | 'super' | 'null' | 'true' | 'false' | ('new' | 'const') type ('.' (id | 'new'))? args | 'const'? targs? list | 'const' collection
          | '(' (arg (',' arg)* ','?)? ')' | HASH id | 'switch' '(' expr ')' '{' (pattern ('when' expr)? '=>' expr (',' pattern ('when' expr)? '=>' expr)* ','?)? '}' ;
list : '[' (elem (',' elem)* ','?)? ']' ;
collection : targs? '{' (elem (',' elem)* ','?)? '}' ;
elem : expr | expr ':' expr | ('...' | '...?') expr | 'if' '(' expr ('case' pattern)? ')' elem ('else' elem)? | 'await'? 'for' '(' forhead ')' elem ;
"""
