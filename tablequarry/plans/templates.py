"""A small set of templates and phrases for the synthesis queries."""

# (pattern, constraints, [(question, constraints)])
TEMPLATES = [
    ("SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP0} {VALUE0}", [],
     [("show the {COLUMN0} of {TABLE0} whose {COLUMN1} {OP0} {VALUE0}", []), ("for which {TABLE1} {COLUMN1} {OP0} {VALUE0} give {COLUMN0}", [])]),
    ("SELECT {AGG0} ( {COLUMN0} ) {FROM} WHERE {COLUMN1} {OP0} {VALUE0} AND {COLUMN2} {OP1} {VALUE1}", ["P0=P1=="],
     [("what is the {AGG0} {COLUMN0} where {COLUMN1} {OP0} {VALUE0} and {COLUMN2} {OP1} {VALUE1}", [])]),
    ("SELECT {COLUMN0} {FROM} GROUP BY {COLUMN0} ORDER BY COUNT ( * ) {DASC} LIMIT {VALUE0}", [],
     [("which {COLUMN0} of {TABLE0} SC_COL_COUNT_LIMIT", [])]),
    ("SELECT {COLUMN0} {FROM} ORDER BY {COLUMN1} {DASC} LIMIT {VALUE0}", [], [("give {COLUMN0} with SC_COL_LIMIT {COLUMN1}", [])]),
    ("SELECT COUNT ( * ) {FROM} WHERE {COLUMN0} BETWEEN {VALUE0} AND {VALUE1}", [], [("how many {TABLE0} have {COLUMN0} between {VALUE0} and {VALUE1}", [])]),
    ("SELECT {COLUMN0} , {COLUMN1} {FROM} WHERE {COLUMN2} = {VALUE0}", [], [("list {COLUMN0} and {COLUMN1} of {TABLE0} with {COLUMN2} {VALUE0}", [])]),
    ("SELECT {COLUMN0} {FROM} EXCEPT SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP0} {VALUE0}", ["C0-id", "T0-T1-JOIN"],
     [("which {COLUMN0} have no {TABLE1} whose {COLUMN1} {OP0} {VALUE0}", [])]),
    ("SELECT {COLUMN0} {FROM} GROUP BY {COLUMN0} HAVING COUNT ( * ) {OP0} {VALUE0}", [], [("which {COLUMN0} of {TABLE0} appear {OP0} {VALUE0} times", [])]),
    ("SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP0} ( SELECT {AGG0} ( {COLUMN1} ) {FROM} )", ["P0=>"],
     [("show {COLUMN0} where {COLUMN1} {OP0} the {AGG0}", [])]),
    ("SELECT {COLUMN0} {FROM} ORDER BY {COLUMN1} {DASC}", [], [("list {COLUMN0} sorted by SC_COL-C1", []), ("list {COLUMN0} SC by {COLUMN1}", [])]),
]

PHRASES = {
    "OP": {
        "=": ["is", "equals"], ">": ["is more than", "is above"], "<": ["is less than", "is below"], ">=": ["is at least"], "<=": ["is at most"],
        "!=": ["is not"], "LIKE": ["contains"],
    },
    "AGG": {"MAX": ["highest", "largest"], "MIN": ["lowest"], "SUM": ["total"], "AVG": ["average", "mean"]},
    "SC": {"ASC": ["in ascending order", "from low to high"], "DESC": ["in descending order"]},
    "SC_COL": {"ASC": ["ascending [COL]"], "DESC": ["descending [COL]", "[COL] from high to low"]},
    "SC_COL_LIMIT": {"ASC": ["the lowest"], "DESC": ["the highest"], "ASC_NUM": ["the [NUM] lowest"], "DESC_NUM": ["the [NUM] highest", "the top [NUM]"]},
    "SC_COL_COUNT_LIMIT": {
        "ASC": ["is least common"], "DESC": ["is most common"], "ASC_NUM": ["are the [NUM] least common"], "DESC_NUM": ["are the [NUM] most common"],
    },
}


def template_frame(spark):
    rows = [(i, p, c, 1, [(q, qc) for q, qc in qs]) for i, (p, c, qs) in enumerate(TEMPLATES)]
    schema = "template_id int, pattern string, constraints array<string>, count int, questions array<struct<text:string,constraints:array<string>>>"
    return spark.createDataFrame(rows, schema)


def phrase_frame(spark):
    rows = [(c, k, p) for c, m in PHRASES.items() for k, p in m.items()]
    return spark.createDataFrame(rows, "component string, key string, phrases array<string>")
