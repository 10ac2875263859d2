"""Enum domains and model tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by stored ordinal.
ENUMS: dict[str, list[str]] = {
    "resolution": ["Exact", "Conservative", "Ambiguous", "Unresolved"],
    "origin": ["CompilerAST", "CompilerPreprocessor", "CompilationDatabase", "DerivedCanonicalization", "DerivedLogicalEquivalence", "DerivedFlowAnalysis"],
    "quality": ["Complete", "CompleteWithWarnings", "Partial", "Failed"],
    "language": ["C", "Cxx", "ObjectiveC", "ObjectiveCxx", "Unknown"],
    "linkage": ["Invalid", "None", "Internal", "UniqueExternal", "External"],
    "visibility": ["Invalid", "Hidden", "Protected", "Default"],
    "access": ["Invalid", "Public", "Protected", "Private"],
    "role": ["Declaration", "Definition", "Reference", "Implicit"],
    "dispatch": ["None", "Static", "Virtual", "Dynamic", "Unresolved"],
    "target_kind": ["Unknown", "Executable", "StaticLibrary", "SharedLibrary", "ObjectLibrary", "Test"],
    "root_kind": ["ProcessEntry", "Export", "Manual", "AddressTaken"],
    "domain": ["Project", "External", "Dependent", "Indirect", "Unknown"],
    "failure": [
        "None", "NoProjectSymbol", "AmbiguousProjectSymbol", "CrossConfigurationVariant", "UnsupportedImplicitCallable", "DependentExpression",
        "IndirectFlow", "ExternalBoundary", "Unknown",
    ],
    "symbol": [
        "Unknown", "Namespace", "NamespaceAlias", "Class", "Struct", "Union", "Function", "Method", "Constructor", "Destructor", "ConversionFunction",
        "OperatorFunction", "Variable", "Field", "Parameter", "Enum", "Enumerator", "Typedef", "TypeAlias", "ClassTemplate", "FunctionTemplate",
        "VariableTemplate", "AliasTemplate", "TemplateTypeParameter", "TemplateNonTypeParameter", "TemplateTemplateParameter", "Macro",
        "UsingDeclaration", "UsingDirective", "Lambda", "LocalVariable",
    ],
    "type": [
        "Invalid", "Builtin", "Named", "Pointer", "LValueReference", "RValueReference", "Array", "Function", "MemberPointer", "TemplateSpecialization",
        "Auto", "Decltype", "Dependent", "Unknown",
    ],
    "relationship": [
        "Contains", "LexicalParent", "SemanticParent", "Declares", "Defines", "References", "Reads", "Writes", "Calls", "Constructs", "Destroys",
        "TakesAddress", "Inherits", "Overrides", "UsesType", "ReturnsType", "ParameterType", "FieldType", "Instantiates", "Specializes", "Includes",
        "CallableValueFlow", "InvokesCallable",
    ],
}
CALLS, CONSTRUCTS, DESTROYS, TAKES_ADDRESS, INHERITS, OVERRIDES = 8, 9, 10, 11, 12, 13
CONTAINS, INSTANTIATES, SPECIALIZES, VALUE_FLOW, INVOKES = 0, 18, 19, 21, 22
EXACT, CONSERVATIVE, UNRESOLVED = 0, 1, 3
STATIC, VIRTUAL, DYNAMIC = 1, 2, 3
AST, CANONICAL, LOGICAL, FLOW = 0, 3, 4, 5
PROJECT, EXTERNAL, INDIRECT, UNKNOWN_DOMAIN = 0, 1, 3, 4
FUNCTION, METHOD, CLASS, CLASS_TEMPLATE, FUNCTION_TEMPLATE, LAMBDA, LOCAL_VARIABLE = 6, 7, 3, 19, 20, 29, 30
METHODS = (7, 8, 9, 10, 11)
CALLABLE = (6, *METHODS, 20, 29)
RECORDS = (3, 4, 5, 19)
#: What a class may inherit from: records, aliases, and template parameters that stand for types.
BASES = (*RECORDS, 17, 18, 22, 23, 25)


def enum_name(ordinal: Column, domain: str) -> Column:
    """Name of an ordinal; 'Invalid' out of range or for null."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ENUMS[domain]]), ordinal.cast("int")), F.lit("Invalid"))


def enum_sql(expr: str, domain: str) -> str:
    """enum_name as portable SQL."""
    return f"case {expr} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(ENUMS[domain])) + " else 'Invalid' end"
