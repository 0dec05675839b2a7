import pytest
from pyspark.sql import functions as F

from marlstone.operators import code, locate, rules
from marlstone.schemas import MODEL

SOURCE = '''from sales import Order
import datetime as dt
class ClientManager(Base, pkg.Mixin):
    def create(self, amount: float, tags: list[str], *, flag: bool = False):
        order.status = "NEW"
        self.bus.publish("OrderPlaced", order)
async def go(): pass
'''


def test_relations():
    r = code.relations(SOURCE)
    assert r["imports"] == [{"module": "sales", "names": ["Order"], "type": "from", "line": 1}, {"module": "datetime", "names": None, "type": "import", "line": 2}]
    assert r["classes"] == [{"name": "ClientManager", "line": 3, "bases": ["Base"], "methods": ["create"]}]
    assert r["functions"] == [{"name": "create", "line": 4, "parameters": [{"name": "self", "type": None}, {"name": "amount", "type": "float"}, {"name": "tags", "type": None}], "in_class": "ClientManager"}]
    assert r["assignments"] == [{"line": 5, "target": "order.status", "value_type": "str", "value": "NEW"}]
    assert r["function_calls"] == [{"line": 6, "function": "publish", "args": ["OrderPlaced"]}]
    assert code.relations("def f(:")["error"].startswith("Syntax Error: ")
    assert code.relations("from . import x\na[0] = b = 1\n(c, d) = e")["imports"] == []
    assert [a["target"] for a in code.relations("a[0] = b = 1\n(c, d) = e")["assignments"]] == [None, "b", None]


def model(project="shop"):
    lang = lambda e, v, d: (e, v, d)
    return (
        project, None,
        [
            ("CustomerManagement", None, ["OrderProcessing"], lang([("Customer", None, ["Client", "User"])], [("Address", ["street"], None)], ["CustomerCreated"])),
            ("OrderProcessing", None, ["CustomerManagement"], lang([("Order", None, None), ("OrderItem", None, ["Item"])], [("OrderStatus", ["value"], None), ("Money", ["amount", "currency"], None)], ["OrderPlaced"])),
            ("PaymentProcessing", None, ["OrderProcessing"], lang([("Payment", None, [])], None, ["PaymentCompleted"])),
            ("InventoryManagement", None, None, None),
            None,
        ],
        ("PascalCase", ["Manager", "Util", "Info", None]),
    )


def check(spark, files):
    parsed = code.parse_code(spark.createDataFrame(files, "submission_id bigint, project_name string, filename string, content string"))
    return {(r["submission_id"], r["type"], r["subject"]) for r in rules.violations(parsed, spark.createDataFrame([model()], MODEL)).collect()}


def test_rules(spark):
    got = check(spark, [
        (1, "shop", "payment_util.py", "class paymentUtil: pass"),
        (2, "shop", "a.py", SOURCE),
        (3, "shop", "b.py", "def get_user_info(): pass"),
        (4, "shop", "payment_processing/c.py", "from inventory_management.product import Product\nfrom order_processing.x import Y\nimport payment_processing"),
        (5, "shop", "order_processing/d.py", 'emit_event("PaymentCompleted")\nemit_event("OrderPlaced")'),
        (6, "shop", "e.py", "class CustomerRepository: pass\nclass OrderItem: pass\ndef __init__(self): pass"),
        (7, "shop", "f.py", "def f(:"),
        (8, "other", "g.py", "x"),
        (9, "shop", "h.py", None),
        (10, "shop", "i.py", 'class Payment: pass\nself.bus.publish("OrderPlaced")'),
    ])
    assert got == {
        (1, "BannedTermViolation", "payment_util.py"), (1, "BannedTermViolation", "paymentUtil"), (1, "NamingConventionViolation", "paymentUtil"),
        (2, "SynonymViolation", "ClientManager"), (2, "BannedTermViolation", "ClientManager"), (2, "ValueObjectViolation", "amount"), (2, "ValueObjectViolation", "order.status"),
        (3, "SynonymViolation", "get_user_info"), (3, "BannedTermViolation", "get_user_info"),
        (4, "ContextBoundaryViolation", "inventory_management.product"),
        (5, "DomainEventViolation", "PaymentCompleted"),
        (7, "SyntaxError", "f.py"), (8, "ConfigError", "g.py"), (10, "DomainEventViolation", "OrderPlaced"),
    }


def test_terms_meet_by_equal_words(spark):
    df = spark.createDataFrame([("HTTPServerItem", "p")], "name string, project string")
    plan = rules.terms_in(df, spark.createDataFrame([("p", "item")], "project string, term_key string"), ["project"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    runs = set(df.select(rules.word_runs(F.col("name")).alias("r")).first()["r"])
    assert runs == {"http", "server", "item", "httpserver", "serveritem", "httpserveritem"}
    long = spark.createDataFrame([("a_b_c_d_e_f_g_h",), ("__",), (None,)], "name string").select(rules.word_runs(F.col("name")).alias("r")).collect()
    assert "abcdefgh" in long[0]["r"] and len(long[0]["r"]) == 36 and long[1]["r"] == []


CODE = "# Client here\nx = Client\nclass Client(Base):\n  def run_it(self):\n    total = 1  # other\n"


@pytest.mark.parametrize("term, want", [("Client", (2, 6)), ("run_it", (3, 6)), ("total", (4, 4)), ("Base", (2, 13)), ("other", (0, 0)), ("", (0, 0)), ("a.b(", (0, 0)), ("x", (1, 0))])
def test_locate(spark, term, want):
    r = spark.createDataFrame([(CODE, term)], "c string, k string").select(locate.locate(F.col("c"), F.col("k")).alias("r")).first()["r"]
    assert (r["line"], r["col"]) == want


def test_diagnostics(spark, rows):
    df = spark.createDataFrame([("u", 1, "m 'K' n", "s", ["A", "B"])], "uri string, line int, message string, suggestion string, sections array<string>")
    assert df.select(locate.keyword(F.col("message")).alias("k")).first()["k"] == "K"
    assert df.select(locate.diagnostic(F.col("message"), F.col("suggestion"), F.col("sections")).alias("d")).first()["d"] == "m 'K' n\ns\n[1] A\n[2] B"
    assert [(r["title"], r["preferred"]) for r in locate.actions(df).collect()] == [("[1] View Source: A", True), ("[2] View Source: B", False)]
    s = spark.createDataFrame([("u", 1, 0, "a"), ("u", 1, 1, "b"), ("u2", 1, 0, "c")], "uri string, line int, n int, sources string")
    assert rows(locate.last_by_line(s, "n")) == [("u", 1, "b"), ("u2", 1, "c")] and locate.without_prefix(s, "u").count() == 0
    assert spark.range(1).select(locate.first_line_of(F.lit("a\nb\nc"), F.lit("c")).alias("n")).first()["n"] == 2


def test_locate_covers_violations_and_all_names(spark, tmp_path, monkeypatch):
    from marlstone.plans import reference

    text = "class A:\n    pass\nclass B:\n    def go(self):\n        total = 1\n"
    files = spark.createDataFrame([(1, "p", "a.py", text), (2, "p", "b.py", "limit = 2\n")], "submission_id bigint, project_name string, filename string, content string")
    found = spark.createDataFrame([(2, "BannedTermViolation", "variable 'limit' contains the banned term 'limit'", 1), (2, "ConfigError", "No domain model", 0)], "submission_id bigint, type string, message string, line int")
    monkeypatch.setattr(reference, "_files", lambda *_: files)
    monkeypatch.setattr(reference, "_models", lambda *_: None)
    monkeypatch.setattr(reference.rules, "violations", lambda *_: found)
    got = {(r["submission_id"], r["kind"], r["name"], r["found_line"], r["found_col"]) for r in reference.x02_locate(spark, "").collect()}
    assert got == {
        (1, "class", "A", 0, 6), (1, "class", "B", 2, 6), (1, "function", "go", 3, 8), (1, "assignment", "total", 4, 8),
        (2, "assignment", "limit", 0, 0), (2, "BannedTermViolation", "limit", 0, 0), (2, "ConfigError", "", 0, 0),
    }
