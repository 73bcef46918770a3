"""Fixed programs, dealt to the parts by number, that between them meet the rules of every agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = '"""Module."""\n# note\n'
DOC = '    """Do it."""\n'


def _lines(n: int, text: str) -> str:
    return "\n".join(text.format(k=k) for k in range(n))


#: Name and text of each program. Line breaks are kept from their ends, where they count as uneven spacing.
SNIPPETS: tuple[tuple[str, str], ...] = (
    ("async_only", HEAD + 'async def fetch(value):\n    """Do it."""\n    return value'),
    ("clean_class", HEAD + 'class Box:\n    """Hold it."""\n    def size(self, items):\n        """Count."""\n        # check\n        if items is None or items == []:\n            total = 0\n        else:\n            total = len(items)\n        return total'),
    ("evals", HEAD + 'def run(text):\n    """Do it."""\n    return eval(text), exec(text), compile(text)'),
    ("open_unmanaged", HEAD + 'def read(name):\n    """Do it."""\n    handle = open(name)\n    return handle.read()'),
    ("path_built", HEAD + 'def read(base, name):\n    """Do it."""\n    try:\n        # note\n        with open(base + name) as handle:\n            return handle.read()\n    except OSError:\n        pass'),
    ("pickles", HEAD + 'import pickle\nimport yaml\ndef load(data):\n    """Do it."""\n    return pickle.loads(data), yaml.load(data)'),
    ("secret_names", HEAD + 'login_token = "abcdefghijklm"\nimport sys'),
    ("open_ifs", HEAD + "def pick(value):\n" + DOC + _lines(4, "    # step {k}\n    if value == {k}:\n        value = value + 1") + "\n    return value"),
    ("chained", HEAD + "def pick(value):\n" + DOC + _lines(4, "    # step {k}\n    seen = 0 < value < {k} and value and seen and value") + "\n    return seen"),
    ("contracts", HEAD + 'def give(value):\n    """Return it. Raises an error."""\n    # note\n    if value is None:\n        print(value)\n    else:\n        print(value)'),
    ("bad_names", HEAD + 'def DoThing(A):\n    """Do it."""\n    B = A\n    C = B\n    return C\nclass lower:\n    """Hold it."""'),
    ("private_first", HEAD + 'def _a_first():\n    """Do it."""\ndef second():\n    """Do it."""\ndef _third():\n    """Do it."""\ndef fourth():\n    """Do it."""'),
    ("elif_chain", HEAD + "def pick(value):\n" + DOC + "    # note\n    if value == 1:\n        out = 2\n" + _lines(6, "    elif value == {k}:\n        # case\n        out = {k}") + "\n    else:\n        out = None\n    return out"),
    ("god_class", HEAD + 'class Big:\n    """Hold it."""\n' + _lines(21, '    def step_{k}(self):\n        """Do it."""\n        # note')),
    ("bases", HEAD + 'class Many(Aaa, Bbb, Ccc, Ddd):\n    """Hold it."""'),
    ("long_function", HEAD + "def work():\n" + DOC + _lines(103, "    # note\n    print({k})")),
    ("deep_loops", HEAD + "def work(rows):\n" + DOC + "    # note\n    for one in rows:\n        for two in one:\n            for three in two:\n                for four in three:\n                    print(four)"),
    ("concatenation", HEAD + "def join(rows):\n" + DOC + "    # note\n    out = \"\"\n    for row in rows:\n        out += \"row\"\n" + _lines(14, "    # line {k}") + "\n    return out"),
    ("bubble", HEAD + "# for all for each if a > b swap\n# end"),
    ("many_params", HEAD + "def work(one, two, three, four, five, six, seven, eight, nine):\n" + DOC + "    global state\n    # note\n    while True:\n        state = one"),
    ("late_imports", HEAD + "value = 5\nimport zlib\nimport json"),
    ("recursion", HEAD + 'def down(value):\n    """Do it."""\n    # note\n    if value is None:\n        return 0\n    else:\n        return down(sorted([value for value in value]))'),
    ("duplicates", HEAD + _lines(3, "print(\"one\")\n# two\nprint(\"three\")")),
    ("complex", HEAD + "def work(value):\n" + DOC + _lines(18, "    # step {k}\n    if value and value:\n        print(value)\n    else:\n        print(0)")),
    ("patch_complex", HEAD + "def work(value):\n" + DOC + _lines(22, "    # step {k}\n    while value:\n        if value:\n            print(value)\n        else:\n            print(0)")),
    ("context_risks", HEAD + "# admin payment production user input\nimport os\ntoken = os.environ"),
    ("xml_weak", HEAD + "import hashlib\ndigest = hashlib.md5(password)\n# login"),
    ("broken", HEAD + "def work(:\n    pass"),
)


def programs(part: DataFrame) -> DataFrame:
    """(sample_id, code, name): the program whose number is the part's key modulo their count."""
    number = (F.col("p_partkey") % len(SNIPPETS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SNIPPETS]), number)
    return part.select(F.col("p_partkey").alias("sample_id"), pick(1).alias("code"), pick(0).alias("name"))


def distinct(part: DataFrame) -> DataFrame:
    """(sample_id, code, name, n): each text once, with the number of parts that have it.

    What is found in a text depends on nothing else, so it is found once.
    """
    return programs(part).groupBy("code", "name").agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("n"))


#: Checked by hand against the rules: agent, type, severity and number of the issues of each program.
ISSUES = {
    "async_only": (
    ),
    "clean_class": (
        "correctness missing_edge_case medium 1",
    ),
    "evals": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "correctness execution medium 1",
        "security eval_execution critical 1",
        "security exec_execution critical 1",
        "security code_execution critical 3",
        "security security_cascade critical 1",
        "security compliance_failure critical 1",
    ),
    "open_unmanaged": (
        "correctness ast_analysis high 1",
        "correctness missing_exception_handling high 1",
        "correctness missing_input_validation medium 1",
        "correctness resource_leak_risk high 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "correctness execution medium 1",
    ),
    "path_built": (
        "correctness ast_analysis low 1",
        "correctness empty_exception_handler medium 1",
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "correctness execution medium 1",
        "security path_traversal_concat medium 1",
        "security path_traversal medium 1",
    ),
    "pickles": (
        "correctness missing_exception_handling high 1",
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "security pickle_loads_unsafe high 1",
        "security yaml_load_unsafe high 1",
        "security dangerous_import high 1",
        "security unsafe_deserialization high 1",
        "security compound_vulnerability critical 1",
        "security security_cascade critical 1",
        "security compliance_failure critical 1",
        "security compliance_failure high 1",
        "security vulnerable_dependency high 1",
        "security vulnerable_dependency medium 1",
        "style import_organization low 1",
    ),
    "secret_names": (
        "correctness execution medium 1",
        "security hardcoded_secret high 1",
        "security dangerous_import medium 1",
        "style import_organization low 1",
    ),
    "open_ifs": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness logic high 1",
        "correctness potential_bug high 4",
    ),
    "chained": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness production_readiness high 1",
    ),
    "contracts": (
        "correctness contract_violation medium 2",
    ),
    "bad_names": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "style variable_naming low 1",
        "style function_naming low 1",
        "style class_naming low 1",
    ),
    "private_first": (
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "style function_naming low 1",
    ),
    "elif_chain": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "performance loop_nesting high 1",
        "style refactoring_opportunities low 1",
    ),
    "god_class": (
        "correctness exception_coverage high 1",
        "correctness missing_input_validation medium 21",
        "correctness missing_edge_case medium 21",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "style architectural_concerns medium 1",
        "style srp_violation medium 1",
    ),
    "bases": (
        "style deep_inheritance medium 1",
    ),
    "long_function": (
        "correctness exception_coverage high 1",
        "correctness ast_analysis high 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "style maintainability_index high 1",
        "style halstead_complexity high 1",
        "style architectural_concerns medium 1",
        "style god_function high 1",
    ),
    "deep_loops": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 2",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "performance loop_nesting high 1",
        "performance performance_bottleneck high 2",
        "style refactoring_opportunities low 1",
    ),
    "concatenation": (
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 2",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "performance performance_antipattern medium 1",
    ),
    "bubble": (
        "performance algorithm_inefficiency medium 4",
    ),
    "many_params": (
        "correctness ast_analysis low 2",
        "correctness ast_analysis high 1",
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "correctness execution medium 1",
        "style architectural_concerns medium 1",
    ),
    "late_imports": (
        "style import_organization low 1",
    ),
    "recursion": (
        "correctness missing_edge_case medium 1",
    ),
    "duplicates": (
        "style code_duplication medium 1",
    ),
    "complex": (
        "correctness complexity high 1",
        "correctness exception_coverage high 1",
        "correctness ast_analysis high 1",
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "performance cyclomatic_complexity high 1",
        "performance cognitive_complexity medium 1",
        "style code_duplication medium 1",
        "style architectural_concerns medium 1",
    ),
    "patch_complex": (
        "correctness complexity high 1",
        "correctness exception_coverage high 1",
        "correctness ast_analysis high 1",
        "correctness missing_input_validation medium 1",
        "correctness missing_edge_case medium 1",
        "correctness edge_case_coverage high 1",
        "correctness production_readiness high 1",
        "performance cyclomatic_complexity high 1",
        "performance cognitive_complexity medium 1",
        "style maintainability_index medium 1",
        "style code_duplication medium 1",
        "style architectural_concerns medium 1",
        "style god_function high 1",
    ),
    "context_risks": (
        "correctness execution medium 1",
        "security dangerous_import high 1",
        "style import_organization low 1",
    ),
    "xml_weak": (
        "security md5_usage high 1",
        "security crypto_compliance_failure high 1",
        "style import_organization low 1",
    ),
    "broken": (
        "correctness ast_analysis critical 1",
        "correctness logic high 1",
        "correctness production_readiness high 1",
        "correctness potential_bug high 1",
        "correctness execution high 1",
        "style import_organization low 1",
        "style maintainability_index high 1",
        "style variable_naming low 1",
        "style function_naming low 1",
        "style class_naming low 1",
        "style code_clarity low 1",
        "style logical_structure low 1",
        "style consistency low 1",
    ),
}

#: Checked by hand against the rules: name, context, functions, classes, cyclomatic and cognitive complexity, nesting, exception coverage,
#: input validation, resource safety, logic, clarity, edge cases, time, space, scale risk, pattern, concerns, refactorings, docs.
FACTS = (
    ('async_only', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('clean_class', 'snippet_context', 1, 1, 3, 2, 1, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 'O(n)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('evals', 'snippet_context', 1, 0, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('open_unmanaged', 'snippet_context', 1, 0, 1, 0, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('path_built', 'snippet_context', 1, 0, 3, 1, 2, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n²)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('pickles', 'snippet_context', 1, 0, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('secret_names', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('open_ifs', 'snippet_context', 1, 0, 5, 4, 1, 0.0, 0.0, 1.0, 0.6, 1.0, 1.0, 'O(n)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('chained', 'snippet_context', 1, 0, 13, 12, 0, 0.0, 0.0, 1.0, 1.0, 0.2, 1.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('contracts', 'snippet_context', 1, 0, 2, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 'O(n)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('bad_names', 'snippet_context', 1, 1, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('private_first', 'snippet_context', 4, 0, 1, 0, 0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('elif_chain', 'snippet_context', 1, 0, 8, 28, 7, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 'O(n^7)', 'O(1)', 0.05, 'general', 0, 1, 1.0),
    ('god_class', 'patch_context', 21, 1, 1, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.0, 'general', 1, 0, 1.0),
    ('bases', 'snippet_context', 0, 1, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('long_function', 'full_file', 1, 0, 1, 0, 0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 'O(1)', 'O(1)', 0.1, 'general', 1, 0, 1.0),
    ('deep_loops', 'snippet_context', 1, 0, 5, 10, 4, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n^4)', 'O(1)', 0.45, 'general', 0, 1, 1.0),
    ('concatenation', 'snippet_context', 1, 0, 2, 1, 1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n)', 'O(1)', 0.065, 'general', 0, 0, 1.0),
    ('bubble', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('many_params', 'snippet_context', 1, 0, 2, 1, 1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n)', 'O(1)', 0.065, 'general', 1, 0, 1.0),
    ('late_imports', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('recursion', 'snippet_context', 1, 0, 2, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 'O(n log n)', 'O(n)', 0.0, 'sorting', 0, 0, 1.0),
    ('duplicates', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('complex', 'patch_context', 1, 0, 37, 36, 1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n)', 'O(1)', 0.06, 'general', 1, 0, 1.0),
    ('patch_complex', 'full_file', 1, 0, 45, 66, 2, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 'O(n²)', 'O(1)', 0.3, 'general', 1, 0, 1.0),
    ('context_risks', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('xml_weak', 'snippet_context', 0, 0, 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8, 'O(1)', 'O(1)', 0.0, 'general', 0, 0, 1.0),
    ('broken', 'snippet_context', 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.8, 'O(?)', 'O(?)', 0.0, 'general', 0, 0, 0.0),
)
FACT_NAMES = (
    "name", "context", "functions", "classes", "cyclomatic", "cognitive", "depth", "exception_coverage", "input_validation", "resource_safety", "logic", "clarity", "edge",
    "time_class", "space_class", "risk", "pattern", "concerns", "refactorings", "docs",
)


def _values(rows) -> str:
    def cell(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)"

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


DEALT = f"dealt AS (SELECT name, count(*) AS parts FROM part JOIN (VALUES {_values((k, n) for k, (n, _) in enumerate(SNIPPETS))}) AS t(k, name) ON p_partkey % {len(SNIPPETS)} = k GROUP BY name)"
ISSUES_ORACLE = (
    f"WITH {DEALT}, expected(name, agent, type, severity, times) AS (VALUES {_values((n, *r.split()[:3], int(r.split()[3])) for n, own in ISSUES.items() for r in own)})"
    " SELECT name, agent, type, severity, CAST(sum(times * parts) AS BIGINT) AS n FROM expected JOIN dealt USING (name) GROUP BY ALL"
)
FACTS_ORACLE = f"WITH {DEALT}, expected({', '.join(FACT_NAMES)}) AS (VALUES {_values(FACTS)}) SELECT expected.*, parts AS n FROM expected JOIN dealt USING (name)"
