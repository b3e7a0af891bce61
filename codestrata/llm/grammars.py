"""Grammars for the derivative parser: Python 3, GDScript 4, ECMAScript modules, TypeScript, Go.

They follow the published grammars with one liberty: operators are read flat (precedence does not decide validity). Only names, members, subscripts and
patterns can be assigned to, and constants need a value. Terminals in capitals come from the lexers; NL is a line end that may stand for a semicolon.
"""

PYTHON = """
file = (NEWLINE | stmt)* ;
stmt = compound | line ;
line = small (';' small)* [';'] NEWLINE ;
block = line | NEWLINE INDENT stmt+ DEDENT ;
id = NAME | 'match' | 'case' | 'type' ;
small = 'pass' | 'break' | 'continue' | 'return' [stars] | 'raise' [expr ['from' expr]] | ('global' | 'nonlocal') id (',' id)*
      | 'del' target (',' target)* [','] | 'assert' expr [',' expr] | import | 'type' id [tparams] '=' expr | assignment ;
import = 'import' dotted ['as' id] (',' dotted ['as' id])*
       | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* [','] ')') ;
imported = id ['as' id] ;
dotted = id ('.' id)* ;
assignment = value | (targets '=')+ value | single AUGMENTED value | single ':' expr ['=' value] ;
single = id | postfix ('[' subscript (',' subscript)* [','] ']' | '.' id) | '(' single ')' ;
targets = starred (',' starred)* [','] ;
starred = ['*'] (single | '(' [targets] ')' | '[' [targets] ']') ;
value = yield | stars ;
yield = 'yield' ['from' expr | stars] ;
stars = star (',' star)* [','] ;
star = '*' expr | expr ;
named = id ':=' expr | expr ;
starnamed = '*' expr | named ;
expr = flat ['if' flat 'else' expr] | 'lambda' [lparams] ':' expr ;
flat = unary (binary unary)* ;
binary = 'or' | 'and' | 'in' | 'not' 'in' | 'is' ['not'] | '*' | '**' | '-' | '+' | '|' | '@' | BINARY ;
unary = ('not' | '-' | '+' | '~' | 'await')* postfix ;
postfix = atom ('(' [args] ')' | '[' subscript (',' subscript)* [','] ']' | '.' id)* ;
target = '*' target | postfix | '(' target ')' ;
args = arg (',' arg)* [','] ;
arg = id '=' expr | named [comp] | '*' expr | '**' expr ;
subscript = [expr] ':' [expr] [':' [expr]] | starnamed ;
atom = id | NUMBER | STRING+ | 'None' | 'True' | 'False' | '...' | '(' [yield | group] ')' | '[' [group] ']' | '{' [entries] '}' ;
group = starnamed (comp | (',' starnamed)* [',']) ;
entries = entry (comp | (',' entry)* [',']) | starnamed (comp | (',' starnamed)* [',']) ;
entry = expr ':' expr | '**' expr ;
comp = ['async'] 'for' target (',' target)* [','] 'in' flat (comp | 'if' (id ':=' expr | flat) )* ;
params = param (',' param)* [','] ;
param = id [':' expr] ['=' expr] | '*' [id [':' star]] | '**' id [':' expr] | '/' ;
lparams = lparam (',' lparam)* [','] ;
lparam = id ['=' expr] | '*' [id] | '**' id | '/' ;
tparams = '[' tparam (',' tparam)* [','] ']' ;
tparam = ('*' | '**')* id [':' expr] ['=' star] ;
compound = decorated | if | while | for | try | with | match ;
decorated = ('@' named NEWLINE)* (['async'] function | class) | 'async' (for | with) ;
function = 'def' id [tparams] '(' [params] ')' ['->' expr] ':' block ;
class = 'class' id [tparams] ['(' [args] ')'] ':' block ;
if = 'if' named ':' block ('elif' named ':' block)* ['else' ':' block] ;
while = 'while' named ':' block ['else' ':' block] ;
for = 'for' target (',' target)* [','] 'in' stars ':' block ['else' ':' block] ;
try = 'try' ':' block ('finally' ':' block | ('except' ['*'] [expr (',' expr)* ['as' id]] ':' block)+ ['else' ':' block] ['finally' ':' block]) ;
with = 'with' (item (',' item)* | '(' item (',' item)* [','] ')') ':' block ;
item = expr ['as' target] ;
match = 'match' starnamed (',' starnamed)* [','] ':' NEWLINE INDENT ('case' patterns ['if' named] ':' block)+ DEDENT ;
patterns = pattern (',' pattern)* [','] ;
pattern = '*' id | simple ('|' simple)* ['as' id] ;
simple = ['-'] NUMBER [('+' | '-') NUMBER] | STRING+ | 'None' | 'True' | 'False' | dotted ['(' [parg (',' parg)* [',']] ')'] | '(' [patterns] ')' | '[' [patterns] ']'
       | '{' [pair (',' pair)* [',']] '}' ;
parg = id '=' pattern | pattern ;
pair = '**' id | simple ':' pattern ;
"""

GDSCRIPT = """
file = (NEWLINE | ';' | member)* ;
annotation = '@' WORD ['(' [args] ')'] ;
member = annotation+ (NEWLINE | declaration) | declaration ;
id = NAME | 'get' | 'set' | 'match' | 'when' ;
declaration = 'class_name' id ['extends' base] [',' STRING] end | 'extends' base end | ['static'] variable | constant | 'signal' id ['(' [sparams] ')'] end
            | 'enum' [id] '{' [enumerator (',' enumerator)* [',']] '}' end | ['static'] 'func' id signature ':' suite
            | 'class' id ['extends' base] ':' (NEWLINE INDENT (NEWLINE | ';' | member)+ DEDENT | 'pass' end) | 'pass' end ;
end = NEWLINE | ';' ;
base = (STRING | id) ('.' id)* ;
type = ('void' | id) ('.' id)* ['[' type (',' type)* ']'] ;
typed = ':' [type] ;
enumerator = id ['=' expr] ;
sparams = id [':' type] (',' id [':' type])* [','] ;
variable = 'var' id [typed] ['=' expr] (end | ':' (NEWLINE INDENT accessor+ DEDENT | accessor)) ;
accessor = 'get' (['(' ')'] ':' suite | '=' id (',' | end)*) | 'set' ('(' id [':' type] ')' ':' suite | '=' id (',' | end)*) ;
constant = 'const' id [typed] '=' expr end ;
signature = '(' [params] ')' ['->' type] ;
params = param (',' param)* [','] ;
param = '...' id [typed] | id [typed] ['=' expr] ;
suite = simple (';' simple)* [';'] NEWLINE | NEWLINE INDENT (NEWLINE | ';' | stmt)+ DEDENT | compound ;
lambda_suite = simple (';' simple)* [NEWLINE] | NEWLINE INDENT (NEWLINE | ';' | stmt)+ DEDENT [NEWLINE] ;
stmt = annotation+ (NEWLINE | stmt) | variable | constant | simple end | compound ;
simple = 'pass' | 'break' | 'continue' | 'breakpoint' | 'return' [expr] | 'assert' '(' args ')' | 'var' id [typed] ['=' expr] | 'const' id [typed] '=' expr | expr | place ('=' | AUGMENTED) expr ;
place = id | postfix ('[' expr ']' | '.' WORD) | '(' place ')' ;
compound = 'if' expr ':' suite ('elif' expr ':' suite)* ['else' ':' suite] | 'for' id [':' type] 'in' expr ':' suite | 'while' expr ':' suite
         | 'match' expr ':' NEWLINE INDENT (NEWLINE | branch)+ DEDENT ;
branch = annotation* pattern (',' pattern)* ['when' expr] ':' suite ;
pattern = 'var' id | '..' | '[' [pattern (',' pattern)* [',']] ']' | '{' [pentry (',' pentry)* [',']] '}' | expr ;
pentry = '..' | expr [':' pattern] ;
expr = flat ['if' flat 'else' expr] ;
flat = unary (binary unary | 'as' type | 'is' ['not'] type)* ;
binary = 'or' | 'and' | 'in' | 'not' 'in' | '-' | '+' | '%' | '&' | '^' | BINARY ;
unary = ('not' | '!' | '-' | '+' | '~' | 'await')* postfix ;
postfix = atom ('(' [args] ')' | '[' expr ']' | '.' WORD)* ;
args = expr (',' expr)* [','] ;
atom = id | 'self' | 'super' | 'true' | 'false' | 'null' | 'void' | NUMBER | STRING | NODE | '%' id | '&' STRING | '^' STRING | '(' expr ')' | '[' [args] ']'
     | '{' [entry (',' entry)* [',']] '}' | 'func' [id] signature ':' lambda_suite ;
entry = expr ':' expr | WORD '=' expr ;
"""

_SCRIPT = """
file = item* ;
soft = 'from' | 'as' | 'of' | 'get' | 'set' | 'async' | 'static' | 'let' | 'accessor' <TS| 'type' | 'interface' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly'
     | 'public' | 'private' | 'protected' | 'override' | 'keyof' | 'is' | 'infer' | 'asserts' | 'satisfies' | 'unique' | 'global' | 'out' TS> ;
id = NAME | soft ;
term = ';' | NL ;
item = 'import' (STRING [attributes] | <TS['type']TS> clause 'from' STRING [attributes]) term | export | stmt <TS| 'import' id '=' expr termTS> ;
attributes = 'with' object ;
clause = id [',' (named | namespace_import)] | named | namespace_import ;
namespace_import = '*' 'as' id ;
named = '{' [spec (',' spec)* [',']] '}' ;
spec = <TS['type']TS> (WORD | STRING) ['as' (WORD | STRING)] ;
export = decorator* 'export' ( 'default' (function | class | assign term <TS| 'abstract' class | interfaceTS>) | declaration | <TS['type']TS> named ['from' STRING [attributes]] term
       | '*' ['as' (WORD | STRING)] 'from' STRING [attributes] term <TS| '=' expr termTS>) ;
declaration = variables term | function | class <TS| alias term | interface | enum | 'declare' declaration | 'declare' 'const' variable (',' variable)* term | 'abstract' class | 'declare' ambientTS> ;
stmt = ';' | block | declaration | 'if' '(' expr ')' stmt ['else' stmt] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [term] | for
     | ('break' | 'continue') [id] term | 'return' [expr] term | 'throw' expr term | 'debugger' term | 'try' block (catch ['finally' block] | 'finally' block)
     | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | id ':' stmt | expr term | decorator+ class <TS| ambientTS> ;
catch = 'catch' ['(' binding ')'] block ;
block = '{' stmt* [NL] '}' ;
variables = ('var' | 'let') variable (',' variable)* | 'const' initialised (',' initialised)* ;
initialised = binding '=' assign ;
variable = binding ['=' assign] ;
binding = (id | array | object) <TS['!'] [':' type]TS> ;
for = 'for' ['await'] '(' ([variables | expr] ';' [expr] ';' [expr] | (('var' | 'let' | 'const') binding | postfix) ('of' | 'in') expr) ')' stmt ;
expr = assign (',' assign)* ;
assign = place ('=' | ASSIGN) assign | chain | arrow | 'yield' ['*'] [assign] ;
chain = unary (binary unary | '?' assign ':' assign <TS| ('as' | 'satisfies') typeTS>)* ;
place = id | postfix ('.' (WORD | PRIVATE) | '[' expr ']' <TS| '!'TS>) | array | object | '(' place ')' <TS| '(' expr ')'TS> ;
arrow = ['async'] (id | <TS[tparams]TS> '(' [params] ')' <TS[':' type]TS>) '=>' (block | assign) ;
binary = 'in' | 'instanceof' | '*' | '-' | '+' | '<' | '>' ['>' ['>']] ['>='] | '>=' | '&' | '|' | BINARY ;
unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new')* postfix ['++' | '--'] ;
postfix = primary ('.' (WORD | PRIVATE) | '?.' (WORD | PRIVATE | '[' expr ']' | '(' [args] ')') | '[' expr ']' | '(' [args] ')' | template <TS| '!' | targsTS>)* ;
args = arg (',' arg)* [','] ;
arg = ['...'] assign ;
primary = id | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | PRIVATE | template | '(' expr ')' | array | object | function | class
        | 'new' '.' 'target' | 'import' ('(' args ')' | '.' 'meta') ;
template = TEMPLATE | TPLHEAD expr (TPLMIDDLE expr)* TPLTAIL ;
array = '[' ','* [arg (','+ arg)* ','*] ']' ;
object = '{' [property (',' property)* [',']] [NL] '}' ;
property = '...' assign | key ':' assign | id ['=' assign] | method ;
key = WORD | STRING | NUMBER | PRIVATE | '[' assign ']' ;
method = ['async'] ['*'] key call_signature block | ('get' | 'set') key call_signature block ;
call_signature = <TS[tparams]TS> '(' [params] ')' <TS[':' type]TS> ;
function = ['async'] 'function' ['*'] [id] call_signature block <TS| ['async'] 'function' [id] call_signature termTS> ;
params = param (',' param)* [','] ;
param = decorator* <TS('public' | 'private' | 'protected' | 'readonly' | 'override')*TS> ['...'] (id | array | object <TS| 'this'TS>) <TS['?'] [':' type]TS> ['=' assign] ;
decorator = '@' postfix ;
class = 'class' [id] <TS[tparams]TS> ['extends' postfix] <TS['implements' type (',' type)*]TS> '{' (class_member | NL)* '}' ;
class_member = ';' | 'static' block | decorator* <TS modifier* TS> ('static' <TS modifier* TS>) ( member_rest ) | decorator* <TS modifier* TS> member_rest ;
member_rest = method | ['accessor'] key <TS['?' | '!'] [':' type]TS> ['=' assign] term <TS| ['async'] ['*'] key ['?'] call_signature (block | term) | ('get' | 'set') key call_signature term | index_signature termTS> ;
<TSmodifier = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ;
index_signature = '[' id ':' type ']' ':' type ;
tparams = '<' tparam (',' tparam)* [','] '>' ;
tparam = ('const' | 'in' | 'out')* id ['extends' type] ['=' type] ;
targs = '<' type (',' type)* '>' ;
alias = 'type' id [tparams] '=' type ;
interface = 'interface' id [tparams] ['extends' type (',' type)*] type_body ;
enum = ['const'] 'enum' id '{' [key ['=' assign] (',' key ['=' assign])* [',']] [NL] '}' ;
ambient = ('namespace' | 'module' | 'global') [STRING | id ('.' id)*] '{' (item | ['export'] 'const' variable (',' variable)* term)* [NL] '}' ;
type = ['|' | '&'] joined (('|' | '&') joined)* ['extends' type '?' type ':' type] | ['abstract'] ['new'] [tparams] '(' [params] ')' '=>' type | ['asserts'] (id | 'this') ['is' type] ;
joined = ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer')* primitive ('[' [type] ']')* ;
primitive = (id | 'void' | 'null' | 'this' | 'typeof' | 'import' '(' STRING ')') ('.' WORD)* [targs] | STRING | TEMPLATE | 'true' | 'false' | ['-'] NUMBER | '(' type ')' | type_body
          | TPLHEAD type (TPLMIDDLE type)* TPLTAIL | '[' [telement (',' telement)* [',']] ']' ;
telement = ['...'] [id ['?'] ':'] type ['?'] ;
type_body = '{' (type_member | ';' | ',' | NL)* '}' ;
type_member = (('get' | 'set')* ['readonly' | '-' 'readonly' | '+' 'readonly'] key ['?'] [call_signature | ':' type] | call_signature | 'new' call_signature | ['readonly'] index_signature
            | ['readonly' | '-' 'readonly' | '+' 'readonly'] '[' id 'in' type ['as' type] ']' [['-' | '+'] '?'] [':' type]) (';' | ',' | NL) ;TS>
"""


def _script(typed: bool) -> str:
    import re

    return re.sub(r"<TS(.*?)TS>", lambda m: m[1] if typed else "", _SCRIPT, flags=re.S)


JAVASCRIPT, TYPESCRIPT = _script(False), _script(True)

GO = """
file = ';'* 'package' id ';' ('import' (import_spec | '(' [import_spec (';' import_spec)* [';']] ')') ';' | ';')* [top (';' [top])*] ;
id = NAME ;
import_spec = [id | '.'] STRING ;
top = function | declaration ;
declaration = 'var' group_var | 'const' group_const | 'type' group_type ;
group_var = var_spec | '(' [var_spec (';' var_spec)* [';']] ')' ;
var_spec = ids (type ['=' exprs] | '=' exprs) ;
group_const = const_spec | '(' [const_spec (';' const_spec)* [';']] ')' ;
const_spec = ids [[type] '=' exprs] ;
group_type = type_spec | '(' [type_spec (';' type_spec)* [';']] ')' ;
type_spec = id [tparams] ['='] type ;
tparams = '[' tparam (',' tparam)* [','] ']' ;
tparam = ids constraint ;
constraint = ['~'] type ('|' ['~'] type)* ;
ids = id (',' id)* ;
function = 'func' ['(' [params] ')'] id [tparams] signature [block] ;
signature = '(' [params] ')' [type | '(' [params] ')'] ;
params = param (',' param)* [','] ;
param = [id] ['...'] type ;
type = id ['.' id] ['[' type (',' type)* [','] ']'] | '*' type | '(' type ')' | literal_type | ['<-'] 'chan' ['<-'] type | 'func' signature
     | 'interface' '{' [element (';' element)* [';']] '}' ;
literal_type = '[' [expr | '...'] ']' type | 'map' '[' type ']' type | 'struct' '{' [field (';' field)* [';']] '}' ;
field = (ids type | ['*'] id ['.' id] ['[' type (',' type)* ']']) [STRING] ;
element = id signature | constraint ;
block = '{' stmts '}' ;
stmts = [stmt] (';' [stmt])* ;
stmt = declaration | simple | 'return' [exprs] | ('go' | 'defer') expr | ('break' | 'continue' | 'goto') [id] | 'fallthrough' | block | if | switch | for | select | id ':' [stmt] ;
simple = exprs ['<-' expr] | places '=' exprs | place (AUGMENTED expr | '++' | '--') | ids ':=' exprs ;
places = place (',' place)* ;
place = id | '*' unary | operands ('.' id | '[' index ']') | '(' place ')' ;
if = 'if' [[simple] ';'] expr block ['else' (if | block)] ;
switch = 'switch' [[simple] ';'] [simple] '{' (('case' typesorexprs | 'default') ':' stmts)* '}' ;
typesorexprs = (expr | type) (',' (expr | type))* ;
for = 'for' [expr | [simple] ';' [expr] ';' [simple] | [exprs ('=' | ':=')] 'range' expr] block ;
select = 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
exprs = expr (',' expr)* ;
expr = unary (('*' | '-' | '+' | '&' | '^' | '|' | '<-' | BINARY) unary)* ;
unary = ('-' | '+' | '!' | '^' | '*' | '&' | '<-')* operands ;
operands = operand ('.' (id | '(' (type | 'type') ')') | '[' index ']' | '(' [args] ')' | literal)* ;
operand = id | NUMBER | STRING | '(' (expr | type) ')' | 'func' signature [block] | literal_type | 'chan' type | 'interface' '{' [element (';' element)* [';']] '}' ;
index = (expr | type) (',' (expr | type))* [','] | [expr] ':' [expr] [':' expr] ;
args = argument (',' argument)* ['...'] [','] ;
argument = expr | type ;
literal = '{' [entry (',' entry)* [',']] '}' ;
entry = (expr | literal) [':' (expr | literal)] ;
"""
