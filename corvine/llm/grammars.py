"""Grammars of the supported dialects, in the notation of corvine.llm.gll."""

from __future__ import annotations

from corvine.llm.gll import Grammar

PYTHON = r"""
%list Args PosArg ,
%list ListIn StarNamed ,
%list DictIn DictItem ,
%list Params Plain ,
Line = Small (';' Small)* ';'?
Small = Assign | StarExprs | Flow | Import | 'global' Names | 'nonlocal' Names | 'del' Target (',' Target)* ','? | 'assert' Expr (',' Expr)? | 'type' Name TypeParams? '=' Expr
Flow = 'pass' | 'break' | 'continue' | 'return' StarExprs? | 'raise' (Expr ('from' Expr)?)? | Yield
Yield = 'yield' 'from' Expr | 'yield' StarExprs?
Assign = (Targets '=')+ Rhs | OneTarget ':' Expr ('=' Rhs)? | OneTarget AugOp Rhs
Rhs = StarExprs | Yield
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Targets = Target | StarTarget (',' StarTarget)+ ','? | StarTarget ','
StarTarget = '*'? Target
Target = Name | Primary '.' Name | Primary B:Slices | P:ParenTargets | B:ParenTargets
OneTarget = Name | Primary '.' Name | Primary B:Slices | P:OneTarget
ParenTargets = (StarTarget (',' StarTarget)* ','?)?
Names = Name (',' Name)*
Name = NAME | 'match' | 'case' | 'type'
Import = 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | ImportNames | P:ImportNamesC)
Dotted = Name ('.' Name)*
ImportNames = Name ('as' Name)? (',' Name ('as' Name)?)*
ImportNamesC = ImportNames ','?
StarExprs = StarExpr (',' StarExpr)* ','?
StarExpr = '*' Or | Expr
StarNamed = '*' Or | Named
Named = Name ':=' Expr | Expr
Expr = Or ('if' Or 'else' Expr)? | 'lambda' LambdaParams? ':' Expr
Or = Not (('or' | 'and') Not)*
Not = 'not'* Comparison
Comparison = Unary (BinOp Unary)*
BinOp = 'in' | 'not' 'in' | 'is' | 'is' 'not' | '<' | '>' | '==' | '!=' | '<=' | '>=' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
Unary = ('-' | '+' | '~')* 'await'? Primary
Primary = Atom Trailer*
Trailer = '.' Name | P:Args | B:Slices
Atom = Name | 'True' | 'False' | 'None' | NUM | STR+ | BYTES+ | '...' | P:ParenIn | B:ListIn | B:CompIn | C:DictIn | C:DictComp | C:ListIn1 | C:CompIn
ParenIn = StarNamed? | StarNamed (',' StarNamed)* ','? | Named Comp | Yield
ListIn = (StarNamed (',' StarNamed)* ','?)?
ListIn1 = StarNamed (',' StarNamed)* ','?
CompIn = Named Comp
DictIn = (DictItem (',' DictItem)* ','?)?
DictItem = Expr ':' Expr | '**' Or
DictComp = Expr ':' Expr Comp
Comp = ('async'? 'for' Targets 'in' Or ('if' Or)*)+
Args = (PosArg (',' PosArg)* (',' Keywords)? ','? | Keywords ','? | Named Comp)?
PosArg = '*' Expr | Named
Keywords = Keyword (',' (Keyword | '*' Expr))* (',' Doubles)? | Doubles
Keyword = Name '=' Expr
Doubles = '**' Expr (',' ('**' Expr | Keyword))*
Slices = Slice (',' Slice)* ','?
Slice = Expr? ':' Expr? (':' Expr?)? | Named | '*' Or
LambdaParams = LNames ','? | (LNames ',')? LStar ','?
LNames = LSome | Name (',' Name)* ',' '/' (',' LSome)? | (Name ',')* LDef (',' LDef)* ',' '/' (',' LDef)*
LSome = Name (',' Name)* (',' LDef)* | LDef (',' LDef)*
LDef = Name '=' Expr
LStar = '*' Name (',' Name ('=' Expr)?)* (',' '**' Name)? | '*' (',' Name ('=' Expr)?)+ (',' '**' Name)? | '**' Name
Params = (PNames ','? | (PNames ',')? PStar ','?)?
PNames = PSome | Plain (',' Plain)* ',' '/' (',' PSome)? | (Plain ',')* PDef (',' PDef)* ',' '/' (',' PDef)*
PSome = Plain (',' Plain)* (',' PDef)* | PDef (',' PDef)*
Plain = Name (':' Expr)?
PDef = Name (':' Expr)? '=' Expr
PStar = '*' Name (':' StarExpr)? (',' (Plain | PDef))* (',' PDouble)? | '*' (',' (Plain | PDef))+ (',' PDouble)? | PDouble
PDouble = '**' Name (':' Expr)?
TypeParams = B:TypeParamList
TypeParamList = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? Name (':' Expr)? ('=' StarExpr)?
Head = HIf | HElif | HElse | HWhile | HFor | HTry | HExcept | HFinally | HWith | HDef | HClass
HIf = 'if' Named ':'
HElif = 'elif' Named ':'
HElse = 'else' ':'
HWhile = 'while' Named ':'
HFor = 'async'? 'for' Targets 'in' StarExprs ':'
HTry = 'try' ':'
HExcept = 'except' ('*'? Expr ('as' Name)?)? ':'
HFinally = 'finally' ':'
HWith = 'async'? 'with' (WithItem (',' WithItem)* | P:WithItems) ':'
WithItem = Expr ('as' StarTarget)?
WithItems = WithItem (',' WithItem)* ','?
HDef = 'async'? 'def' Name TypeParams? P:Params ('->' Expr)? ':'
HClass = 'class' Name TypeParams? P:Args? ':'
HMatch = 'match' (StarNamed ',' (StarNamed (',' StarNamed)* ','?)? | Named) ':'
HCase = 'case' Patterns ('if' Named)? ':'
Patterns = Pattern (',' Pattern)* ','?
Pattern = '*' Name | OrPattern ('as' Name)?
OrPattern = ClosedPattern ('|' ClosedPattern)*
ClosedPattern = '-'? NUM (('+' | '-') NUM)? | STR+ | BYTES+ | 'True' | 'False' | 'None' | Dotted P:PatternArgs? | P:PatternsOpt | B:PatternsOpt | C:PatternMap
PatternsOpt = Patterns?
PatternArgs = (PatternArg (',' PatternArg)* ','?)?
PatternArg = (Name '=')? Pattern
PatternMap = (PatternPair (',' PatternPair)* ','?)?
PatternPair = '**' Name | ('-'? NUM (('+' | '-') NUM)? | STR+ | BYTES+ | 'True' | 'False' | 'None' | Dotted) ':' Pattern
Deco = '@' Named
Field = StarExprs | Yield
ILine = Head Line
ICase = HCase Line
File = Stmt*
Suite = Stmt+
Stmt = SIMPLE | If | While | For | Try | With | DEF (C:Suite) | DECO+ (DEF | CLASS) C:Suite | CLASS C:Suite | DECO* (DEFI | CLASSI) | MATCH C:Cases
If = (IF C:Suite | IFI) (ELIF C:Suite | ELIFI)* Else?
Else = ELSE C:Suite | ELSEI
While = (WHILE C:Suite | WHILEI) Else?
For = (FOR C:Suite | FORI) Else?
With = WITH C:Suite | WITHI
Try = (TRY C:Suite | TRYI) (Except+ Else? Finally? | Finally)
Except = EXCEPT C:Suite | EXCEPTI
Finally = FINALLY C:Suite | FINALLYI
Cases = (CASE C:Suite | CASEI)+
"""

_JS = r"""
%list File Item ;
%list Block Stmt ;
%list ClassBody ClassMember ;
%list Args Arg ,
%list Elems Elem ,
%list Props Prop ,
File = Item*
Item = Import | Export | Stmt
Semi = ';' | NL | $
Id = NAME | 'let' | 'static' | 'async' | 'of' | 'get' | 'set' | 'as' | 'from' | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'public' | 'private' | 'protected' | 'readonly' | 'implements' | 'override' | 'keyof' | 'infer' | 'is' | 'asserts' | 'unique' | 'satisfies'
Word = Id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'await' | 'yield'
Import = 'import' STR Attrs? Semi | 'import' ImportClause NL? 'from' STR Attrs? Semi
Attrs = 'with' C:Props
ImportClause = Id (',' (NsImport | C:ImportSpecs))? | NsImport | C:ImportSpecs
NsImport = '*' 'as' Id
ImportSpecs = (ImportSpec (',' ImportSpec)* ','?)?
ImportSpec = (Word | STR) ('as' Id)?
Export = 'export' ('*' ('as' (Word | STR))? NL? 'from' STR Attrs? Semi | C:ExportSpecs (NL? 'from' STR Attrs?)? Semi | Declaration | 'default' (Func | AnonFunc | Class | AnonClass | Assign Semi))
ExportSpecs = (ExportSpec (',' ExportSpec)* ','?)?
ExportSpec = (Word | STR) ('as' (Word | STR))?
Declaration = VarDecl Semi | Func | Class
Block = Stmt*
Stmt = C:Block | VarDecl Semi | Expr Semi | If | For | 'while' P:Expr NL? Stmt | 'do' Stmt NL? 'while' P:Expr Semi? | 'continue' Id? Semi | 'break' Id? Semi | 'return' Expr? Semi | 'throw' Expr Semi | 'switch' P:Expr C:Cases | Try | 'debugger' Semi | Func | Class | Id ':' Stmt | ';' | NL
If = 'if' P:Expr NL? Stmt (NL? 'else' NL? Stmt)?
For = 'for' 'await'? P:ForHead NL? Stmt
ForHead = (VarDecl | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const') Binding ('of' Assign | 'in' Expr) | Target ('of' Assign | 'in' Expr)
Try = 'try' C:Block NL? ('catch' P:CatchParam? C:Block NL? ('finally' C:Block)? | 'finally' C:Block)
Cases = CaseItem*
CaseItem = ('case' Expr | 'default') ':' | Stmt
VarDecl = ('var' | 'let') VarItem (',' VarItem)* | 'const' ConstItem (',' ConstItem)*
AnonFunc = 'async'? 'function' '*'? Sig C:Block
Func = 'async'? 'function' '*'? Id Sig C:Block
Class = Decorator* 'class' Id ClassTail
AnonClass = Decorator* 'class' ClassTail
Decorator = '@' Member NL?
Expr = Assign (',' Assign)*
Assign = Cond | Target '=' Assign | OneTarget AssignOp Assign | Arrow | 'yield' ('*'? Assign)?
OneTarget = Id | Prim Tail* ('.' (Word | PRIV) | B:Expr) | P:OneTarget
Target = OneTarget | B:PatElems | C:PatProps
PatElems = PatElem? (',' PatElem?)*
PatElem = '...'? Target ('=' Assign)?
PatProps = (PatProp (',' PatProp)* ','?)?
PatProp = '...' Target | PropName ':' Target ('=' Assign)? | Id ('=' Assign)?
AssignOp = '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond = Bin ('?' Assign ':' Assign)?
Bin = Terms (('||' | '&&') Terms)* | Terms ('??' Terms)+
BinOp = '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | 'in' | 'instanceof'
UnaryOp = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await'
Unary = UnaryOp+ Postfix | Postfix ('**' Unary)?
Postfix = Member | OneTarget ('++' | '--') | ('++' | '--') OneTarget
Member = Prim Tail*
Prim = Id | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | TPL | REGEX | PRIV | P:Expr | B:Elems | C:Props | FuncExpr | AnonClass | Class | 'new' NewTarget | 'import' P:Args | 'import' '.' Id | 'new' '.' Id
FuncExpr = 'async'? 'function' '*'? Id? Sig C:Block
Binding = Id | B:BindElems | C:BindProps
BindElems = BindElem? (',' BindElem?)*
BindElem = '...'? Binding ('=' Assign)?
BindProps = (BindProp (',' BindProp)* ','?)?
BindProp = '...' Binding | PropName ':' Binding ('=' Assign)? | Id ('=' Assign)?
PropName = Word | STR | NUM | PRIV | B:Assign
Params = (Param (',' Param)* ','?)?
Props = (Prop (',' Prop)* ','?)?
Prop = '...' Assign | PropName ':' Assign | Id | Method
MethodKind = 'async' '*'? | 'get' | 'set' | '*'
Method = MethodKind? PropName Sig C:Block
Elems = Elem? (',' Elem?)*
Elem = '...'? Assign
Args = (Arg (',' Arg)* ','?)?
Arg = '...'? Assign
"""

JAVASCRIPT = _JS + r"""
VarItem = Id ('=' Assign)? | (B:BindElems | C:BindProps) '=' Assign
ConstItem = Binding '=' Assign
Sig = P:Params
ClassTail = ('extends' Member)? C:ClassBody
ClassBody = ClassMember*
ClassMember = ';' | NL | Decorator* 'static'? Method | Decorator* 'static'? PropName ('=' Assign)? Semi | 'static' C:Block
CatchParam = Binding
Terms = Unary (BinOp Unary)*
Tail = '.' (Word | PRIV) | '?.' (Word | PRIV | P:Args | B:Expr | TPL) | B:Expr | P:Args | TPL
NewTarget = Member
Arrow = 'async'? (Id | P:Params) '=>' (C:Block | Assign)
Param = '...'? Binding ('=' Assign)?
"""

TYPESCRIPT = _JS + r"""
Import = 'import' 'type' ImportClause 'from' STR Semi | 'import' 'type'? Id '=' (Member) Semi
ImportSpec = 'type' (Word | STR) ('as' Id)?
Export = 'export' 'type' C:ExportSpecs ('from' STR)? Semi | 'export' 'type' '*' ('as' Word)? 'from' STR Semi | 'export' '=' Expr Semi | 'export' 'as' 'namespace' Id Semi | 'export' 'default' (Interface | 'abstract' Class) | 'export' 'import' Id '=' Member Semi
ExportSpec = 'type' (Word | STR) ('as' (Word | STR))?
Declaration = TsDecl
Stmt = TsDecl
TsDecl = Interface | 'type' Id TypeParams? '=' Type Semi | 'const'? 'enum' Id C:EnumBody | ('namespace' | 'module') (Id ('.' Id)* | STR) C:File | 'declare' (Ambient | Func | Class | TsDecl | ('namespace' | 'module') (Id ('.' Id)* | STR) C:AmbientFile | 'global' C:AmbientFile | NAME C:AmbientFile) | Decorator* 'abstract' Class | 'async'? 'function' '*'? Id Sig Semi
AmbientFile = ('export'? Ambient | Item)*
Ambient = ('var' | 'let' | 'const') Id (':' Type)? ('=' Assign)? (',' Id (':' Type)? ('=' Assign)?)* Semi
Interface = 'interface' Id TypeParams? ('extends' Type (',' Type)*)? C:TypeMembers
EnumBody = (EnumItem (',' EnumItem)* ','?)?
EnumItem = PropName ('=' Assign)?
VarItem = Id '!'? (':' Type)? ('=' Assign)? | (B:BindElems | C:BindProps) (':' Type)? '=' Assign
ConstItem = Binding (':' Type)? '=' Assign
Sig = TypeParams? P:Params (':' RetType)?
RetType = 'asserts' (Id | 'this') ('is' Type)? | (Id | 'this') 'is' Type | Type
ClassTail = TypeParams? ('extends' Member TypeArgs?)? ('implements' Type (',' Type)*)? C:ClassBody
ClassBody = ClassMember*
Mod = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async'
ClassMember = ';' | NL | Decorator* Mod* MethodKind? PropName '?'? Sig C:Block | Decorator* Mod* MethodKind? PropName '?'? Sig Semi | Decorator* Mod* PropName ('?' | '!')? (':' Type)? ('=' Assign)? Semi | 'static' C:Block | Mod* B:IndexKey ':' Type Semi
IndexKey = Id ':' Type
CatchParam = Binding (':' Type)?
Terms = Unary (BinOp Unary | 'as' 'const' | 'as' Type | 'satisfies' Type)*
Unary = '<' Type '>' Unary
OneTarget = Prim Tail* '!' | P:Casted
Casted = Unary 'as' Type
Tail = '.' (Word | PRIV) | '?.' (Word | PRIV | TypeArgs? P:Args | B:Expr | TPL) | B:Expr | P:Args | TPL | '!' | TypeArgs P:Args | TypeArgs TPL
NewTarget = Member | Member TypeArgs P:Args Tail*
Arrow = 'async'? (Id | TypeParams? P:Params (':' RetType)?) '=>' (C:Block | Assign)
Param = Decorator* Mod* '...'? (Binding | 'this') '?'? (':' Type)? ('=' Assign)?
TypeArgs = '<' Type (',' Type)* ','? '>'
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam = ('const' | 'in' | NAME)? Id ('extends' Type)? ('=' Type)?
Type = Union ('extends' Type '?' Type ':' Type)? | FuncType
FuncType = ('abstract'? 'new')? TypeParams? P:Params '=>' RetType
Union = ('|' | '&')? Postf (('|' | '&') Postf)*
Postf = PrimT B:TypeOpt*
TypeOpt = Type?
PrimT = Id ('.' Word)* TypeArgs? | 'this' | 'void' | 'null' | 'true' | 'false' | STR | '-'? NUM | TPL | 'typeof' Member TypeArgs? | ('keyof' | 'unique' | 'readonly' | 'infer') Postf | 'infer' Id 'extends' Type | B:Tuple | C:TypeMembers | C:Mapped | P:Type | 'import' P:Args ('.' Word)* TypeArgs?
Tuple = (TupleItem (',' TupleItem)* ','?)?
TupleItem = '...'? (Id '?'? ':')? Type '?'?
Mapped = (('+' | '-')? 'readonly')? B:MapKey (('+' | '-')? '?')? (':' Type)? ';'?
MapKey = Id 'in' Type ('as' Type)?
TypeMembers = (TypeMember ((';' | ',' | NL) TypeMember)* (';' | ',' | NL)?)?
TypeMember = 'readonly'? PropName '?'? (':' Type)? | MethodKind? PropName? '?'? Sig | 'new' Sig | 'readonly'? B:IndexKey ':' Type
"""

JAVA = r"""
%list Block BlockStmt ;
%list ClassBody Member ;
%list Args Expr ,
%list ArrInit VarInit ,
File = ';'* (Ann* 'package' QName ';')? ('import' 'static'? QName ('.' '*')? ';' | ';')* (TypeDecl | ';')* | ('import' QName ('.' '*')? ';')* Ann* NAME? NAME QName C:ModuleBody
ModuleBody = (NAME NAME? QName (NAME QName (',' QName)*)? ';')*
Id = NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when'
QName = Id ('.' Id)*
Ann = '@' QName P:AnnArgs?
AnnArgs = (AnnArg (',' AnnArg)*)?
AnnArg = (Id '=')? AnnVal
AnnVal = Cond | Ann | C:AnnVals
AnnVals = (AnnVal (',' AnnVal)*)? ','?
Mod = Ann | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NAME '-' 'sealed'
TypeDecl = Mod* (ClassD | InterfaceD | EnumD | RecordD | AnnD)
ClassD = 'class' Id TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? C:ClassBody
InterfaceD = 'interface' Id TypeParams? ('extends' Types)? ('permits' Types)? C:ClassBody
EnumD = 'enum' Id ('implements' Types)? C:EnumBody
RecordD = 'record' Id TypeParams? P:FParams ('implements' Types)? C:ClassBody
AnnD = '@' 'interface' Id C:ClassBody
EnumBody = (EnumConst (',' EnumConst)*)? ','? (';' Member*)?
EnumConst = Ann* Id P:Args? C:ClassBody?
Types = Type (',' Type)*
ClassBody = Member*
Member = ';' | TypeDecl | Mod* Type VarDs ';' | Mod* TypeParams? Ann* ResType Id P:FParams B:Empty* ('throws' Types)? (C:Block | ';' | 'default' AnnVal ';') | 'static'? C:Block | Mod* TypeParams? Id P:FParams ('throws' Types)? C:Block | Mod* Id C:Block
ResType = Type | 'void'
Empty = Ann*
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Ann* Id ('extends' Type ('&' Type)*)?
FParams = (FParam (',' FParam)*)?
FParam = Mod* Type '...'? (Id B:Empty* | 'this' | Id '.' 'this')
PrimT = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'byte' | 'short' | 'char'
Type = Ann* (PrimT | ClassType) (Ann* B:Empty)*
ClassType = Id TypeArgs? ('.' Ann* Id TypeArgs?)*
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Ann* '?' (('extends' | 'super') Type)? | Type
VarDs = VarD (',' VarD)*
VarD = Id B:Empty* ('=' VarInit)?
VarInit = Expr | C:ArrInit
ArrInit = (VarInit (',' VarInit)*)? ','?
Block = BlockStmt*
BlockStmt = Mod* Type VarDs ';' | TypeDecl | Stmt
Stmt = C:Block | ';' | StmtExpr ';' | 'if' P:Expr Stmt ('else' Stmt)? | 'while' P:Expr Stmt | 'do' Stmt 'while' P:Expr ';' | 'for' P:ForHead Stmt | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';' | 'switch' P:Expr C:SwitchBody | 'synchronized' P:Expr C:Block | Try | Id ':' Stmt | ('this' | 'super') P:Args ';' | Prim '.' 'super' P:Args ';'
Try = 'try' P:Resources C:Block ('catch' P:CatchP C:Block)* ('finally' C:Block)? | 'try' C:Block ('catch' P:CatchP C:Block)+ ('finally' C:Block)? | 'try' C:Block 'finally' C:Block
Resources = Resource (';' Resource)* ';'?
Resource = Mod* Type Id '=' Expr | Postfix
CatchP = Mod* Type ('|' Type)* Id
ForHead = Mod* Type Id ':' Expr | ForInit? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)?
ForInit = Mod* Type VarDs | StmtExpr (',' StmtExpr)*
Target = Id | Prim Tail* ('.' Id | B:Expr) | P:Target
StmtExpr = Target AssignOp Expr | ('++' | '--') Target | Target ('++' | '--') | Prim Tail* P:Args | New | New Tail* P:Args
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
SwitchBody = SwItem*
SwItem = CaseLabel ':' | CaseLabel '->' (Expr ';' | C:Block | 'throw' Expr ';') | BlockStmt
CaseLabel = 'default' | 'case' CaseVal (',' CaseVal)* ('when' Expr)?
CaseVal = Cond | 'default' | Pattern
Pattern = Mod* Type Id | Type P:Patterns Id?
Patterns = (Pattern (',' Pattern)*)?
Expr = Cond | Target AssignOp Expr | Lambda
Lambda = (Id | P:LambdaPs) '->' (Expr | C:Block)
LambdaPs = (Id (',' Id)*)? | FParam (',' FParam)*
Cond = Bin ('?' Expr ':' (Cond | Lambda))?
Bin = Unary (BinOp Unary | 'instanceof' ('final'? Type Id? | Pattern))*
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
Unary = ('+' | '-' | '!' | '~') Unary | ('++' | '--') Target | P:CastType (Unary | Lambda) | Postfix | Target ('++' | '--')
CastType = Type ('&' Type)*
Postfix = Prim Tail*
Prim = NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | Id | P:Expr | New | 'switch' P:Expr C:SwitchBody | (PrimT | 'void') B:Empty* ('.' 'class' | '::' 'new') | ClassType B:Empty* '::' ('new' | Id)
Tail = '.' TypeArgs? Id | '.' 'class' | '.' 'this' | '.' 'super' | '.' New | B:Expr | B:Empty | P:Args | '::' TypeArgs? (Id | 'new')
New = 'new' Ann* (ClassType P:Args C:ClassBody? | (PrimT | ClassType) (B:Expr+ B:Empty* | B:Empty+ C:ArrInit))
Args = (Expr (',' Expr)*)?
"""

GO = r"""
%list Block StmtS ;
%list Fields FieldS ;
%list Args Arg ,
%list LitValue KeyedEl ,
File = ';'* 'package' NAME Semi ('import' (ImportSpec | P:ImportSpecs) Semi | ';')* ((Decl | Func) Semi | ';')*
Semi = ';' | $
ImportSpec = ('.' | NAME)? STR
ImportSpecs = (ImportSpec (';' ImportSpec)* ';'?)?
Decl = ('var' (VarSpec | P:VarSpecs)) | 'const' (ConstSpec | P:ConstSpecs) | 'type' (TypeSpec | P:TypeSpecs)
VarSpec = Names (Type ('=' Exprs)? | '=' Exprs)
VarSpecs = (VarSpec (';' VarSpec)* ';'?)?
ConstSpec = Names (Type? '=' Exprs)?
ConstSpecs = (ConstSpec (';' ConstSpec)* ';'?)?
TypeSpec = NAME B:TParams? '='? Type
TypeSpecs = (TypeSpec (';' TypeSpec)* ';'?)?
TParams = TParam (',' TParam)* ','?
TParam = NAME Constraint? | Constraint
Constraint = '~'? Type ('|' '~'? Type)*
Names = NAME (',' NAME)*
Func = 'func' NAME B:TParams? P:Params Result? C:Block? | 'func' P:Params NAME P:Params Result? C:Block?
Params = ('...'? Type (',' '...'? Type)* ','? | Named (',' Named)* ','?)?
Named = Names '...'? Type
Result = Type | P:Params
Type = NAME ('.' NAME)? B:TypeArgs? | '*' Type | B:ArrLen Type | 'map' B:Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' P:Params Result? | 'struct' C:Fields | 'interface' C:Iface | P:Type
TypeArgs = Type (',' Type)* ','?
ArrLen = (Expr | '...')?
Fields = FieldS*
FieldS = (Names Type | '*'? NAME ('.' NAME)? B:TypeArgs?) STR? Semi
Iface = (IfaceItem (';' IfaceItem)* ';'?)?
IfaceItem = NAME P:Params Result? | Constraint
Block = StmtS*
StmtS = Stmt Semi | ';' | NAME ':' StmtS
Stmt = Decl | Simple | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | C:Block | If | Switch | 'select' C:CaseBody | For | NAME ':' Stmt?
Simple = Exprs | Exprs AssignOp Exprs | Exprs ':=' Exprs | Expr '++' | Expr '--' | Expr '<-' Expr
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If = 'if' (Simple? ';')? Expr C:Block ('else' (If | C:Block))?
Switch = 'switch' (Simple? ';')? Simple? C:CaseBody
CaseBody = (CaseLabel | StmtS)*
CaseLabel = 'case' (Arg (',' Arg)* | Simple) ':' | 'default' ':'
For = 'for' (Expr | Simple? ';' Expr? ';' Simple? | (Exprs (':=' | '='))? 'range' Expr)? C:Block
Exprs = Expr (',' Expr)*
Expr = Unary (BinOp Unary)*
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Unary | Primary
Primary = Operand PTail*
Operand = NUM | STR | NAME | P:ExprOrType | 'func' P:Params Result? C:Block | TypeLit C:LitValue | TypeLit P:Args
TypeLit = B:ArrLen Type | 'map' B:Type Type | 'chan' '<-'? Type | 'struct' C:Fields | 'interface' C:Iface | 'func' P:Params Result?
ExprOrType = Expr | Type
PTail = '.' NAME | '.' P:TypeAssert | B:Index | P:Args | C:LitValue
TypeAssert = 'type' | Type
Index = ArgT (',' ArgT)* ','? | Expr? ':' Expr? (':' Expr)?
ArgT = Expr | Type
Args = (Arg (',' Arg)* ','?)?
Arg = (Expr | Type) '...'?
LitValue = (KeyedEl (',' KeyedEl)* ','?)?
KeyedEl = (El ':')? El
El = Expr | C:LitValue
"""

#: By extension: the dialect grammars that are run together, the first one first.
DIALECTS = {"py": [PYTHON], "js": [JAVASCRIPT], "ts": [TYPESCRIPT], "go": [GO], "java": [JAVA]}
_built: dict[str, list[Grammar]] = {}


def grammars(extension: str) -> list[Grammar]:
    if extension not in _built:
        _built[extension] = [Grammar(t) for t in DIALECTS[extension]]
    return _built[extension]
