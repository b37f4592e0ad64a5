"""Contracts, plans, metrics, search, federation, evidence, access and decisions on small inputs."""

import json
from datetime import date, datetime

import pytest

from tessera import catalog, certification
from tessera.api import Engine, main, rows
from tessera.decisions import calibration, context, ingest, packs, proposals, trust
from tessera.decisions.ledger import Ledger
from tessera.errors import Clarify, Refusal
from tessera.functions.periods import period_range
from tessera.metrics import certify, formula, kernel, paths
from tessera.metrics.compiler import compile_metric
from tessera.metrics.freshness import freshness
from tessera.metrics.resolve import resolve
from tessera.operators import access, documents, federation, text_search, vector_search
from tessera.operators.evidence import closure_issues, missing_focus
from tessera.plans import contract as contracts
from tessera.plans import rules
from tessera.plans.semantic_plan import compile_plan
from tessera.sources.registry import Source, Sources, check_config, load_sources, redact
from tessera.streaming.events import touched_terms

TEXT = """
# metrics
- delivered revenue: sum of total amount where status = delivered
- bad review count: count of reviews with rating 1
# rules
- active: Ignore product P003 from all calculations
- active: Any product with more than 5 bad reviews is under severe review until cleared
- active: Revenue must use delivered orders only
- active: Analysis must use shop.orders.amount
- active: Fake reviews must not be used to override concerns
- draft: Exclude product P009
- active: Be kind
# dimensions
- shop.orders.order_id: unique identifier for each order
- shop.orders.product_id: product of the order
- shop.orders.customer_id: buyer of the order
- shop.orders.status: state such as delivered or pending
- shop.orders.order_date: calendar date of the order
- shop.products.product_id: unique identifier for each product
- shop.products.product_name: display name of the product
- shop.reviews.review_id: unique identifier for each review
- shop.reviews.product_id: product of the review
- shop.reviews.review_text: body text of the review
- shop.reviews.tags: labels of the review
# measures
- shop.orders.amount: monetary value, default sum
- shop.reviews.rating: stars given, default average
# relations
- shop.orders.product_id = shop.products.product_id
- shop.reviews.product_id = shop.products.product_id
"""
ORDERS = [
    ("O1", "P001", "C1", "delivered", date(2026, 1, 10), 49.99, 0.0), ("O2", "P002", "C1", "delivered", date(2026, 1, 11), 59.98, 5.0), ("O3", "P001", "C2", "pending", date(2026, 1, 12), 49.99, 0.0),
    ("O4", "P003", "C2", "delivered", date(2026, 1, 13), 10.0, 0.0), ("O5", None, "C2", "delivered", date(2025, 12, 31), 7.0, 0.0),
]
PRODUCTS = [("P001", "White Shoes"), ("P002", "Blue Shirt"), ("P003", "Red Hat")]
REVIEWS = [("R1", "P001", "great shoes, great fit", ["ok"], 5), ("R2", "P002", "shirt too small", ["ok", "fit"], 2), ("R3", "P003", "great hat", None, 4), ("R4", None, "no product great", ["fit"], 1)]


@pytest.fixture(scope="module")
def shop(spark):
    orders = lambda s: s.createDataFrame(ORDERS, "order_id string, product_id string, customer_id string, status string, order_date date, amount double, refund double")
    products = lambda s: s.createDataFrame(PRODUCTS, "product_id string, product_name string")
    reviews = lambda s: s.createDataFrame(REVIEWS, "review_id string, product_id string, review_text string, tags array<string>, rating int")
    return contracts.load(TEXT, Sources([Source("shop", "parquet", {}, {"orders": orders, "products": products, "reviews": reviews})]))


def code(call, *args, **kwargs):
    with pytest.raises((Refusal, Clarify)) as e:
        call(*args, **kwargs)
    return e.value.code


def test_rules_compile(shop):
    kinds = [(r["rule_type"], r["application_mode"]) for r in shop.data["rules"]]
    assert kinds == [("row_exclusion", "enforced"), ("threshold_state", "recorded_only"), ("metric_default_filter", "recorded_only"), ("metric_field_binding", "recorded_only"), ("precedence", "recorded_only"), ("row_exclusion", "recorded_only"), ("advisory", "recorded_only")]
    assert {x["field_id"] for x in shop.data["exclusions"]} == {"shop.orders.product_id", "shop.products.product_id", "shop.reviews.product_id"}
    threshold = shop.data["rules"][1]["compiled_policy"]
    assert threshold == {"subject_metric": "bad_review_count", "operator": ">", "value": 5, "state": "severe_review"}
    assert shop.data["rules"][2]["compiled_policy"]["field_id"] == "shop.orders.status"
    assert rules.rule_id("Ignore  X1") == rules.rule_id("ignore x1")
    assert [i.code for i in shop.issues] == ["active_advisory_unstructured"]
    assert len(rules.recorded(shop.data, {"shop.orders.status"})) == 4


@pytest.mark.parametrize(("line", "want"), [
    ("# oddities", "unknown_section"), ("- stray", "bullet_ignored"), ("# dimensions\n- shop.x: y", "malformed_field_token"), ("# dimensions\n- other.t.c: y", "unknown_source"), ("# metrics\n- nothing", "malformed_metric"),
    ("# relations\n- a = b", "malformed_relation"), ("# rules\n## someday\n- x", "rule_status_unknown"), ("# metrics\n## active", "subsection_outside_rules"), ("# rules\n- active: Ignore gadget G001", "enforceable_rule_not_compiled"),
    ("# dimensions\n- shop.t.c: a\n- shop.t.c: b", "duplicate_field_id"), ("# relations\n- shop.t.c = shop.u.c", "relation_references_undeclared_field"), ("# rules\n## draft\n- a b\n# rules\n- bare", "rule_status_required"),
])
def test_contract_issues(line, want):
    data, issues = contracts.parse(line, ["shop"])
    assert want in {i.code for i in (*issues, *contracts.validate(data))}


def test_contract_identity(shop):
    again = contracts.load(TEXT, shop.sources)
    assert again.hash == shop.hash and shop.hash.startswith("sha256:") and len(shop.hash) == 71
    assert contracts.is_current(contracts.canonical_json(shop.data), shop)
    assert contracts.load(TEXT + "- shop.orders.order_id = shop.reviews.review_id\n", shop.sources).hash != shop.hash


def test_declared_columns_exist(spark, shop):
    assert not shop.check_columns(spark)
    odd = contracts.load(TEXT.replace("shop.orders.status", "shop.orders.state"), shop.sources)
    assert [i.code for i in odd.check_columns(spark)] == ["declared_column_missing"]


PLAN = {"select": [{"field": "shop.orders.amount", "aggregation": "sum", "alias": "revenue"}]}


def test_plans(spark, shop):
    run = lambda **p: [tuple(r) for r in compile_plan(spark, shop, p).collect()]
    assert run(**PLAN) == [(159.96,)]  # P003 is excluded, and a null product goes as in SQL
    assert run(**PLAN, apply_global_rules=False) == [(pytest.approx(176.96),)]
    joined = {"select": [{"field": "shop.products.product_name"}, *PLAN["select"]], "joins": [{"left": "shop.products.product_id", "right": "shop.orders.product_id"}], "group_by": ["shop.products.product_name"], "order_by": [{"field": "revenue", "direction": "desc"}], "limit": 1}
    assert run(**joined) == [("White Shoes", 99.98)]
    assert run(select=[{"field": "shop.orders.order_id"}], order_by=[{"field": "shop.orders.amount", "direction": "desc"}, {"field": "order_id"}]) == [("O2",), ("O1",), ("O3",)]
    assert len(run(select=[{"field": "shop.orders.order_id"}], limit=0)) == 1


@pytest.mark.parametrize(("change", "want"), [
    ({"select": [{"field": "shop.orders.amount", "aggregation": "median"}]}, "plan_compile_failed"), ({"select": [{"field": "shop.orders.secret"}]}, "field_not_allowed"), ({"select": []}, "plan_compile_failed"),
    ({"select": [*PLAN["select"], {"field": "shop.orders.status"}]}, "plan_compile_failed"), ({"select": [{"field": "shop.orders.amount", "alias": "a b"}]}, "plan_compile_failed"),
    ({"filters": [{"field": "shop.orders.status", "operator": "like", "value": "x"}]}, "plan_compile_failed"), ({"filters": [{"field": "shop.orders.status", "operator": "in", "value": []}]}, "plan_compile_failed"),
    ({"select": [*PLAN["select"], {"field": "shop.products.product_name"}], "group_by": ["shop.products.product_name"]}, "plan_compile_failed"),
    ({"joins": [{"left": "shop.orders.customer_id", "right": "shop.products.product_id"}]}, "plan_compile_failed"), ({"order_by": [{"field": "revenue", "direction": "up"}]}, "plan_compile_failed"),
])
def test_plans_refused(spark, shop, change, want):
    assert code(compile_plan, spark, shop, PLAN | change) == want


def test_documents_keep_missing(spark, shop):
    ask = lambda f, **k: [r.order_id for r in documents.query_documents(spark, shop, "orders", f, sort=["order_id"], **k).collect()]
    assert ask({}) == ["O1", "O2", "O3", "O5"]
    assert ask({"product_id": {"ne": "P001"}}) == ["O2", "O5"] and ask({"product_id": {"nin": ["P001"]}}) == ["O2", "O5"]
    assert ask({"shop.orders.product_id": {"exists": False}}) == ["O5"] and ask({"product_id": {"eq": "P003"}}) == []
    tags = lambda f: sorted(r.review_id for r in documents.query_documents(spark, shop, "reviews", f).collect())
    assert tags({"tags": "fit"}) == ["R2", "R4"] and tags({"tags": {"ne": "fit"}}) == ["R1"] and tags({"tags": {"in": ["ok"]}}) == ["R1", "R2"]
    assert code(documents.query_documents, spark, shop, "orders", {"$where": 1}) == "not_read_only"
    assert code(documents.query_documents, spark, shop, "orders", {"refund": 1}) == "field_not_allowed"
    assert code(documents.query_documents, spark, shop, "orders", {"status": {"regex": "x"}}) == "operator_not_allowed"


def test_text_search(spark, shop):
    find = lambda q=None, **k: [r.review_id for r in text_search.search_text(spark, shop, "reviews", q, **k).collect()]
    assert find("GREAT") == ["R1", "R4"] and find("shirt fit")[0] == "R2" and find("nothing") == []
    assert find(filters={"tags": ["fit"]}) == ["R2", "R4"] and find(filters={"product_id": "P003"}) == [] and find() == ["R1", "R2", "R4"]
    assert code(text_search.search_text, spark, shop, "orders", "x") == "text_search_fields_unresolved"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [3.0, 0.0])], "id int, v array<float>")
    assert [r.id for r in vector_search.top_k(df, "v", "id", [1.0, 0.0], 3).collect()] == [1, 7, 3]
    assert [r.id for r in vector_search.top_k(df, "v", "id", [1.0, 0.0], 99, "dot").collect()] == [7, 1, 3, 2, 6]
    assert code(vector_search.top_k, df, "v", "id", [1.0, 0.0], 3, "manhattan") == "metric_not_supported"


def test_federation(spark, shop):
    cite = "struct<evidence_id:string,source_id:string,may_support_claims:boolean>"
    left = spark.createDataFrame([(1, "P1", "a", ("e1", "s", True)), (2, None, "b", ("e2", "s", True)), (3, "p2", "c", ("e3", "s", True))], f"i int, k string, shared string, _citation {cite}")
    right = spark.createDataFrame([("p1", "a", ("f1", "t", True)), (" P1 ", "z", ("f2", "t", False)), (None, "b", ("f3", "t", True))], f"k string, shared string, _citation {cite}")
    go = lambda **o: federation.combine_slices(left, right, "k", "k", order=(["i"], ["shared"]), **o)
    assert go().count() == 0 and [r.left_i for r in go(strategy="casefold").collect()] == [1] and not federation.may_support(go(strategy="trimmed"))
    got = go(strategy="trimmed").collect()
    assert [(r.left_i, r.right_shared, [c.field for c in r._conflicts]) for r in got] == [(1, "a", []), (1, "z", ["shared"])]
    assert got[0]._citation.supporting_evidence_ids == ["e1", "f1"] and len(go(strategy="trimmed", limit=1).collect()) == 1
    number = spark.createDataFrame([(1,)], "k int")
    assert federation.combine_slices(number, spark.createDataFrame([("1",)], "k string"), "k", "k").count() == 0
    assert code(federation.combine_slices, left, right, "k", "k", "soundex") == "unknown_match_strategy"
    assert code(federation.combine_slices, left, right, "x", "k") == "join_key_missing"
    assert code(federation.combine_slices, left.where("k is null"), right, "k", "k") == "join_key_missing"
    assert code(federation.combine_slices, spark.range(501).selectExpr("id k"), number, "k", "k") == "federation_slice_too_large"
    assert federation.combine_slices(left.limit(0), right, "k", "k").count() == 0


def test_access():
    roles = {"admin": {"tools": ["*"]}, "viewer": {"tools": ["list_sources"]}}
    access.require_tool(roles, None, "x")
    access.require_tool(None, "anyone", "x")
    access.require_tool(roles, "viewer", "list_sources")
    assert code(access.require_tool, roles, "viewer", "run_guarded_sql") == "role_not_permitted" and code(access.require_tool, roles, "ghost", "x") == "role_not_recognized"
    assert access.decide([{"id": "r", "role": "v*"}], {"role": "viewer"}) == {"allowed": False, "rule_id": "r"} and access.decide([], {})["allowed"]


def test_engine(spark, shop):
    masking = access.Masking(["shop.orders.customer_id"], ["admin"])
    e = Engine(spark, shop, role="viewer", roles={"viewer": {"tools": ["query_documents", "list_sources"]}}, masking=masking)
    answer = e.call("query_documents", table="orders", projection=["order_id", "customer_id"], sort=["order_id"])
    assert {r["customer_id"] for r in rows(answer)} == {access.MASK} and rows(answer)[0]["_citation"]["kind"] == "atomic"
    assert e.call("run_guarded_postgres_sql", sql="select 1")["reason_code"] == "role_not_permitted" and e.call("nope")["reason_code"] == "tool_unknown"
    assert e.call("list_sources")["status"] == "ok"
    free = Engine(spark, shop)
    assert free.call("execute_postgres_semantic_query", plan=PLAN)["status"] == "ok" and free.call("health_check")["healthy"]
    assert free.call("run_guarded_sql", sql="select order_id from orders where product_id <> 'P003'", strict=True)["status"] == "ok"
    assert free.call("run_guarded_sql", sql="select order_id from orders", strict=True)["reason_code"] == "missing_global_exclusion"
    assert free.call("run_guarded_sql", sql="select refund from orders")["reason_code"] == "column_not_allowed"
    assert free.call("run_guarded_sql", sql="select order_id from orders", citation_mode="claim_support")["reason_code"] == "purpose_required"
    assert free.call("validate_analysis_request", request={"metric": "m"})["missing"] == ["time_scope_required", "source_required", "decision_required", "capability_required"] == missing_focus({"metric": "m"})
    assert free.call("metric_query", term="x")["reason_code"] == "kernel_missing"


def test_rules_of_every_class(shop):
    """Each class by its own words, and sentences that only look like one."""
    vocabulary = rules.Vocabulary(shop.data)
    kind = lambda text: (lambda r: (r["rule_type"], r["compiled_policy"]))(rules.classify(text, vocabulary))
    assert kind("Don't count product SKU-9.")[1]["value"] == "SKU-9" and kind("drop customer C9")[1]["targets"][0]["field_id"] == "shop.orders.customer_id"
    assert kind("ignore the noise")[0] == "advisory" and kind("Exclude widget W55") == ("row_exclusion", None)
    assert kind("Ratings may not, in any report, override amounts")[0] == "precedence" and kind("Not now. Overrides are rare")[0] == "advisory"
    assert kind("Stock of at least 3 is under watch, then sold")[1] == {"subject_metric": None, "operator": ">=", "value": 3, "state": "watch"}
    assert kind("delivered revenue >100 is fine")[1] == {"subject_metric": "delivered_revenue", "operator": ">", "value": 100, "state": None}
    assert kind("more than enough")[0] == "advisory" and kind("Use pending orders only")[1]["value"] == "pending"
    assert kind("Values must be based on monetary data")[1] == {"directive": "must_use", "field_id": "shop.orders.amount"} and kind("Use order date")[1]["field_id"] == "shop.orders.order_date"
    assert kind("Be on time")[0] == "advisory"


def test_masks_hold_in_every_tool(spark, shop):
    """Aliases, expressions, filters, aggregates and joins see masked columns, whichever tool reads them."""
    masks = access.Masking(["shop.orders.status", "shop.orders.amount", "shop.orders.product_id", "shop.reviews.review_text"], ["admin"])
    e = Engine(spark, shop, role="analyst", masking=masks, kernel=kernel.load({k: v for k, v in KERNEL.items() if k != "metrics"} | {"metrics": {"gross": {"name": "Gross", "collection": "common", "measure": "amount"}}}))
    plan = lambda *select, **more: rows(e.call("execute_semantic_query", plan={"select": list(select), **more}))
    assert {r["s"] for r in plan({"field": "shop.orders.status", "alias": "s"})} == {access.MASK}
    assert plan({"field": "shop.orders.order_id"}, filters=[{"field": "shop.orders.status", "value": "delivered"}]) == []
    assert [r["a"] for r in plan({"field": "shop.orders.amount", "aggregation": "max", "alias": "a"})] == [None]
    assert plan({"field": "shop.products.product_name"}, {"field": "shop.orders.order_id"}, joins=[{"left": "shop.products.product_id", "right": "shop.orders.product_id"}]) == []
    sql = rows(e.call("run_guarded_sql", sql="select upper(status) as u, amount + 1 as a, length(status) as n, product_id as p from orders where status <> 'pending'"))
    assert {(r["u"], r["a"], r["n"], r["p"]) for r in sql} == {(access.MASK, None, len(access.MASK), None)}
    assert rows(e.call("query_documents", table="orders", filters={"status": "delivered"})) == []
    assert rows(e.call("search_text", table="reviews", query="great")) == []
    assert [r["gross"] for r in rows(e.call("metric_query", term="gross"))] == [None]
    assert [r["gross"] for r in rows(Engine(spark, shop, role="admin", masking=masks, kernel=e.kernel).call("metric_query", term="gross"))] == [159.96]


def test_limits_have_a_total_order(spark, shop):
    got = [r.order_id for r in compile_plan(spark, shop, {"select": [{"field": "shop.orders.order_id"}], "limit": 2}).collect()]
    tied = [r.order_id for r in compile_plan(spark, shop, {"select": [{"field": "shop.orders.order_id"}, {"field": "shop.orders.customer_id"}], "order_by": [{"field": "customer_id", "direction": "desc"}], "limit": 1}).collect()]
    assert got == ["O1", "O2"] and tied == ["O3"]
    assert [r.order_id for r in documents.query_documents(spark, shop, "orders", limit=3).collect()] == ["O1", "O2", "O3"]
    assert code(compile_plan, spark, shop, {**PLAN, "filters": [{"field": "shop.orders.status", "operator": "in", "value": list(range(501))}]}) == "plan_compile_failed"
    assert code(text_search.search_text, spark, shop, "reviews", filters={"tags": list(range(501))}) == "filter_list_too_long"


def test_text_search_over_several_fields(spark):
    """Rows that share an id stay apart, and each is scored by its best field."""
    df = spark.createDataFrame([(1, "red hat", "a hat for all"), (1, "blue", "nothing"), (2, "shirt", "red red red"), (3, None, "hat")], "id int, title string, body string")
    got = text_search.bm25(df, ["title", "body"], ["hat"]).orderBy("id").collect()
    single = {c: {tuple(r)[:3]: r["_score"] for r in text_search.bm25(df, c, ["hat"]).collect()} for c in ("title", "body")}
    assert [tuple(r)[:3] for r in got] == [(1, "red hat", "a hat for all"), (3, None, "hat")]
    assert all(r["_score"] == max(s.get(tuple(r)[:3], 0.0) for s in single.values()) for r in got)


def test_only_pure_functions(spark, shop):
    free = Engine(spark, shop)
    for call in ("input_file_name()", "rand()", "current_date()", "spark_partition_id()", "java_method('a', 'b')"):
        assert free.call("run_guarded_sql", sql=f"select {call} as x from orders")["reason_code"] == "forbidden_function"
    assert free.call("run_guarded_sql", sql="select coalesce(max(abs(amount)), 0) as x from orders")["status"] == "ok"


def test_federation_infers_sources(spark):
    two = contracts.load("# dimensions\n- a.t.k: key of t\n- b.u.k: key of u\n- b.v.k: key of v\n- c.w.k: key of w\n# measures\n- a.t.n: number\n# relations\n- a.t.k = b.u.k\n# metrics\n- m: n\n", Sources([Source(s, "parquet") for s in "abc"]))
    cite = "struct<evidence_id:string,source_id:string,may_support_claims:boolean>"
    part = lambda s: spark.createDataFrame([("x", ("e" + s, s, True))], f"k string, _citation {cite}")
    assert federation.combine_slices(part("a"), part("b"), "k", "k", contract=two).count() == 1
    assert code(federation.combine_slices, part("a"), part("c"), "k", "k", contract=two) == "relation_not_declared"
    assert federation.source_of(part("a").union(part("b"))) is None and federation.source_of(part("a").drop("_citation")) is None


def test_connectors_have_real_options(spark):
    pg = Source("p", "postgres", {"host": "db", "port": 5432, "database": "shop", "schema": "s", "user": "u", "password": "x"})
    assert pg.options("orders") == {"url": "jdbc:postgresql://db:5432/shop", "dbtable": "s.orders", "driver": "org.postgresql.Driver", "user": "u", "password": "x"}
    assert Source("d", "duckdb", {"path": "/x/a.duckdb"}).options("t")["url"] == "jdbc:duckdb:/x/a.duckdb"
    assert Source("m", "mongodb", {"url": "mongodb://h", "database": "d"}).options("c") == {"connection.uri": "mongodb://h", "database": "d", "collection": "c"}
    assert code(pg.scan, spark, "orders") == "connector_missing" and Source("q", "postgres", pg.config, {"t": "t"}).health(spark)["status"] == "error"
    listed = Sources([Source("v", "qdrant", {"url": "http://x", "collection": "c"}), Source("w", "qdrant", {}, {"t": "/x"})])
    assert listed.capability_map() == {"vector_search": ["w"]} and [s["available"] for s in listed.listing()] == [False, True]
    issues = {i.code for i in check_config("sources:\n  a: {type: csv, path: x, colour: red, env: missing.env}\n", "/nowhere")}
    assert issues == {"unexpected_setting", "env_file_missing"}


TERMS = {
    "sales": {"name": "Sales", "collection": "novashop", "aliases": ["Turnover"], "metrics": ["gross"], "owner": "ann", "certified": True, "verified_on": "2026-01-10", "guidance": "delivered orders"},
    "buyer": {"name": "Buyer", "collection": "common", "entities": ["customer"], "certified": True, "verified_on": "2026-01-10"}, "old": {"name": "Old sales", "collection": "novashop", "metrics": ["gross"], "certified": True, "verified_on": "2020-01-01"},
}


def test_terms_are_checked():
    k = kernel.load(KERNEL)
    terms = context.load_terms(TERMS, k, {"old": {"max_age_days": 9999}})
    assert terms["old"].max_age_days == 9999 and context.resolve_term(terms, k, "turnover", "novashop").id == "sales" and code(context.resolve_term, terms, k, "turnover") == "term_unknown"
    for bad in ({"a": {"name": "A"}}, {"a": {"name": "A", "collection": "common", "colour": 1}}, {"a": {"name": "A", "collection": "nope"}}, {"a": {"name": "A", "collection": "common", "metrics": ["nope"]}}, {"a": {"name": "A", "collection": "common"}, "b": {"name": "B", "collection": "common", "aliases": ["a"]}}):
        assert code(context.load_terms, bad, k) == "TERMS_INVALID"
    assert code(context.load_terms, TERMS, k, {"nope": {}}) == "TERMS_INVALID"
    card = context.card(terms["sales"], k)
    assert card["lineage"] == ["column:s.orders.amount", "entity:order", "measure:amount", "metric:gross"] and card["join_paths"] == {"gross/customer": ["oc"], "gross/sku": ["lo"]}
    assert context.facets(terms) == {"collection": {"common": 1, "novashop": 2}, "owner": {"": 2, "ann": 1}, "certified": {"true": 3}}
    model = context.export_model(k, terms)
    assert [m["name"] for m in model["metrics"]] == list(KERNEL["metrics"]) and model["datasets"][0]["source"] == "s.orders"


def test_context_queries_packs_and_decisions(spark, shop, tmp_path):
    k = kernel.load({**KERNEL, "metrics": {"gross": {"name": "Gross", "collection": "novashop", "measure": "amount", "rules": ["active"]}}})
    e = Engine(spark, shop, kernel=k, terms=context.load_terms(TERMS, k), ledger=Ledger(spark, str(tmp_path / "ledger")))
    ask = lambda term, **more: e.call("context_query", term=term, reference_date="2026-02-01", tenant="novashop", **more)
    got = ask("turnover", claim={"period": "2026-01", "revenue_type": "gross"})
    assert (got["answer"], got["trust"]["evidence_tier"], [r["gross"] for r in rows(got)]) == ("answer", 3, [109.97])
    assert ask("sales", claim={"revenue_type": "gross"})["answer"] == "clarify" and ask("sales", claim={"period": "p", "revenue_type": "gross", "reported_as": "net"})["answer"] == "refuse"
    assert ask("buyer")["reason_code"] == "term_without_metric" and ask("old")["reason_code"] == "term_not_usable" and ask("nope")["reason_code"] == "term_unknown"
    subclaims = [{"term": "sales", "tenant": "novashop", "claim": {"period": "2026-01", "revenue_type": "gross"}}]
    compose = lambda claims, **more: e.call("compose_evidence_pack", subclaims=claims, action="pricing:raise", reference_date="2026-02-01", **more)["pack"]
    pack = compose(subclaims)
    assert (pack["decision"], pack["tier"]) == ("answer", "correlational") and compose([*subclaims, {"term": "nope"}])["decision"] == "review_required"
    assert compose(subclaims, bars=[("pricing:", "experimental")])["reasons"] == ["tier_below_bar"] and compose([*subclaims, {"term": "old", "tenant": "novashop"}])["decision"] == "refuse"
    apart = [{**subclaims[0], "group": "g"}, {**subclaims[0], "group": "g", "claim": {"period": "2025-12", "revenue_type": "gross"}}]
    assert compose(apart, triggers=["x*"])["decision"] == "review_required"
    at = datetime(2026, 2, 1)
    made = e.call("record_decision", pack=pack, chosen="raise", at=at)["decision_id"]
    assert made == e.call("record_decision", pack=pack, chosen="raise", at=at)["decision_id"] and e.call("record_decision", pack=pack | {"contract_hash": "x"}, chosen="raise", at=at)["reason_code"] == "pack_expired"
    assert e.call("record_outcome", decision_id=made, observed={"sales": 1}, at=at)["status"] == "ok" and e.call("record_outcome", decision_id="no", observed={}, at=at)["reason_code"] == "decision_unknown"
    assert e.call("replay_decision", pack=pack)["changed"] == []
    other = e.call("counterfactual", pack=pack, change={"bars": [("pricing:*", "established")]})
    assert other["changed"] == ["policy_hash", "decision"] and other["pack"]["decision"] == "review_required"
    assert {r.artifact_type for r in e.ledger.all().select("artifact_type").distinct().collect()} == {"decision", "outcome", "policy_decision"}


def test_advice_by_many_plain_rules(spark, monkeypatch):
    asked = spark.createDataFrame([(k, f"term{k}", "act") for k in range(3000)], "decision_id int, term string, action string")
    many = spark.createDataFrame([(f"term{k}", f"t{k}") for k in range(2500)] + [("a?t", "any")], "pattern string, target_term string")
    assert calibration.advised(asked, many).count() == 2500 + 3000
    monkeypatch.setattr(calibration, "GLOBS", 0)
    assert code(calibration.advised, asked, many) == "too_many_glob_rules"


KERNEL = {
    "collections": {"novashop": {"priority": 100, "tenant": "novashop"}, "common": {"priority": 10}},
    "entities": {"order": {"source": "s", "table": "orders", "primary_key": "order_id", "time_field": "order_date"}, "customer": {"source": "s", "table": "customers", "primary_key": "customer_id"}, "line": {"source": "s", "table": "lines", "primary_key": "line_id"}},
    "measures": {"amount": {"entity": "order", "field": "amount", "aggregation": "sum"}, "refund": {"entity": "order", "field": "refund", "aggregation": "sum"}, "orders": {"entity": "order", "field": "order_id", "aggregation": "count"}, "buyers": {"entity": "order", "field": "customer_id", "aggregation": "count-distinct"}},
    "dimensions": {"customer": {"entity": "customer", "field": "customer_name"}, "sku": {"entity": "line", "field": "sku"}},
    "relations": {"oc": {"left": "order", "right": "customer", "left_key": "customer_id", "right_key": "customer_id"}, "lo": {"left": "line", "right": "order", "left_key": "order_id", "right_key": "order_id"}},
    "rules": {"active": {"filters": {"status": "delivered"}}, "deferred": {"filters": {"status": "pending"}}},
    "metrics": {
        "gross": {"name": "Gross", "collection": "novashop", "measure": "amount", "rules": ["active"], "dimensions": ["customer", "sku"], "synonyms": ["turnover"]}, "deferred": {"name": "Deferred", "collection": "common", "measure": "amount", "rules": ["deferred"]},
        "net": {"name": "Net", "collection": "novashop", "formula": "measure:amount - measure:refund", "rules": ["active"], "dimensions": ["customer"], "synonyms": ["revenue"]}, "count": {"name": "Count", "collection": "novashop", "measure": "orders", "rules": ["active"], "dimensions": ["sku"]},
        "buyers": {"name": "Buyers", "collection": "novashop", "measure": "buyers", "rules": ["active"]}, "per_buyer": {"name": "Per buyer", "collection": "novashop", "formula": "metric:net / metric:buyers", "rules": ["active"], "dimensions": ["customer"]},
    },
}


def test_golden_metrics(spark):
    k = kernel.load(KERNEL)
    data = {
        "orders": spark.createDataFrame(ORDERS[:3], "order_id string, product_id string, customer_id string, status string, order_date date, amount double, refund double"),
        "customers": spark.createDataFrame([("C1", "Alice"), ("C2", "Bob")], "customer_id string, customer_name string"), "lines": spark.createDataFrame([("L1", "O1", "a"), ("L2", "O2", "b"), ("L3", "O2", "c")], "line_id string, order_id string, sku string"),
    }
    value = lambda m, **r: [tuple(x) for x in compile_metric(k, data.__getitem__, k.metrics[m], name="v", **r).df.collect()]
    assert [round(value(m)[0][0], 2) for m in ("gross", "net", "count", "buyers", "per_buyer", "deferred")] == [109.97, 104.97, 2, 1, 104.97, 49.99]
    assert [(n, round(v, 2)) for n, v in value("net", dimensions=("customer",))] == [("Alice", 104.97)]
    assert value("count", dimensions=("sku",)) == [("a", 1), ("b", 1), ("c", 1)]
    assert code(compile_metric, k, data.__getitem__, k.metrics["gross"], ("sku",)) == "METRIC_FANOUT_BLOCKED"
    assert code(compile_metric, k, data.__getitem__, k.metrics["count"], ("sku",), strict=True) == "METRIC_FANOUT_BLOCKED"
    assert code(compile_metric, k, data.__getitem__, k.metrics["gross"], ("nope",)) == "dimension_not_allowed" and code(compile_metric, k, data.__getitem__, k.metrics["gross"], grain="year") == "unsupported_grain"
    made = compile_metric(k, data.__getitem__, k.metrics["gross"], filters={"status": "pending"})
    assert made.caveats == ["rule_override"] and made.df.first()[0] == 49.99
    assert compile_metric(k, data.__getitem__, k.metrics["gross"], filters={"status": "pending"}, strict=True).df.first()[0] is None
    certificate = certify.certify(k, lambda m, r: compile_metric(k, data.__getitem__, m, name="v", **r).df, "count", [{"expected": {"v": 2}}])
    assert certificate["passed"] and not certify.stale(k, [certificate]) and certify.stale(k, [certificate | {"definition_hash": "x"}]) == {"count"}
    row = freshness(data["orders"], "order_date", "2026-02-01", 10).first()
    assert (row.last_day, row.age_days, row.stale) == (date(2026, 1, 12), 20, True) and freshness(data["orders"].limit(0), "order_date", "2026-02-01", 10).first().stale


def test_resolution():
    k = kernel.load(KERNEL)
    assert resolve(k, "Turnover", "novashop").metric.id == "gross" and resolve(k, "deferred", "novashop").caveats == ("fallback_metric",)
    assert code(resolve, k, "turnover", "elsewhere") == "metric_unknown" and resolve(k, "gross", "elsewhere").metric.id == "gross"
    assert resolve(k, "gross", stale=frozenset({"gross"})).caveats == ("uncertified",)


def test_kernel_is_checked():
    broken = lambda **m: {**KERNEL, "metrics": {**KERNEL["metrics"], **m}}
    a = {"name": "A", "collection": "common", "formula": "metric:b + 1"}
    for bad in (broken(a=a, b={**a, "formula": "metric:a"}), broken(a={**a, "formula": "measure:nope"}), broken(a={**a, "extra": 1}), broken(a={**a, "formula": "metric:gross", "grain": "day"}), broken(a={"name": "A", "collection": "x", "measure": "amount"})):
        assert code(kernel.load, bad) == "KERNEL_INVALID"


@pytest.mark.parametrize("text", ["sum(measure:a)", "-measure:a", "measure:a ** 2", "x + 1", "measure:a; drop", "", "(select 1)", "measure:a if 1 else 2", "'a'", "True"])
def test_formulas_refused(text):
    assert code(formula.check, text) == "METRIC_FORMULA_INVALID"


def test_join_paths():
    e = {n: {"source": "s", "table": n, "primary_key": "id"} for n in "abcd"}
    r = lambda x, y, c="many_to_one": {"left": x, "right": y, "left_key": "k", "right_key": "k", "cardinality": c}
    k = kernel.load({"entities": e, "relations": {"r2": r("a", "b"), "r1": r("a", "c"), "r3": r("b", "d"), "r4": r("c", "d")}})
    assert [s.relation for s in paths.join_path(k, "a", "d")] == ["r1", "r4"] and paths.join_path(k, "a", "a") == ()
    back = paths.join_path(k, "d", "a")
    assert {s.cardinality for s in back} == {"one_to_many"} and code(paths.guard_fan_out, back, "sum") == "METRIC_FANOUT_BLOCKED"
    paths.guard_fan_out(back, "max")
    lonely = kernel.load({"entities": e, "relations": {}})
    assert code(paths.join_path, lonely, "a", "b") == "METRIC_NO_JOIN_PATH"


@pytest.mark.parametrize(("name", "reference", "want"), [
    ("ytd", "2026-01-31", (date(2026, 1, 1), date(2026, 1, 31))), ("last_30_days", "2026-01-31", (date(2026, 1, 2), date(2026, 1, 31))), ("prior_period", "2026-01-15", (date(2025, 12, 1), date(2025, 12, 31))),
    ("prior_period", "2026-03-10", (date(2026, 2, 1), date(2026, 2, 28))),
])
def test_periods(name, reference, want):
    assert period_range(name, reference) == want


def test_period_needs_reference():
    assert code(period_range, "ytd", None) == "reference_date_required" and code(period_range, "decade", "2026-01-01") == "unknown_period"


def test_sources(tmp_path, spark):
    good = "sources:\n  shop: {type: parquet, path: data}\n  text: {type: opensearch, url: http://x, index: i, api_key: '${KEY}'}\n"
    s = load_sources(good, tmp_path, {"KEY": "k1"})
    assert not check_config(good) and s.by_id["text"].config["api_key"] == "k1" and redact(s.by_id["text"].config)["api_key"] == "***"
    assert s.resolve("structured_query").source_id == "shop" and s.resolve("text_search", "text").source_id == "text"
    assert code(s.resolve, "text_search", "nope") == "source_not_found_for_capability" and code(s.resolve, "text_search") == "source_selection_required" and code(s.resolve, "levitation") == "no_source_for_capability"
    codes = {i.code for i in check_config("sources:\n  9x: {type: parquet, path: p}\n  a: {type: postgres, host: h, port: 99999, database: d, password: hunter2}\n  b: {type: magic}\n  c: {}\n  d: {type: qdrant, url: nope, collection: c}\n  e: 1\n  f: {type: csv}\n")}
    assert codes == {"invalid_identifier", "invalid_port", "plaintext_secret", "unknown_type", "type_missing", "invalid_url", "source_not_mapping", "required_setting_missing"}
    assert check_config("sources:\n  a: {type: csv, path: x}\n  a: {type: csv, path: y}\n")[0].code == "duplicate_key"
    assert Source("x", "parquet", {}, {"t": "/nowhere"}).health(spark)["status"] == "error"
    (tmp_path / "t.csv").write_text("id,name\n1,a\n2,b\n")
    csv = Source("c", "csv", {"schemas": {"t": "id int, name string"}}, {"t": str(tmp_path / "t.csv")})
    assert [tuple(r) for r in csv.scan(spark, "t").collect()] == [(1, "a"), (2, "b")]


def test_command_line(tmp_path, capsys):
    (tmp_path / "s.yaml").write_text("sources:\n  shop: {type: parquet, path: data}\n")
    (tmp_path / "c.md").write_text(TEXT)
    base = ["--contract", str(tmp_path / "c.md"), "--sources", str(tmp_path / "s.yaml")]
    out = str(tmp_path / "c.json")
    assert main([*base, "--validate", "--write", out]) == 0 and main([*base, "--check", out]) == 0
    (tmp_path / "c.md").write_text(TEXT + "- shop.orders.order_id = shop.reviews.review_id\n")
    assert main([*base, "--check", out]) == 1


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    event = {"artifact_type": "answer", "source_id": "s", "payload": {"b": 1, "a": 2}, "edges": [("x", "y", "uses")], "recorded_at": datetime(2026, 1, 1), "contract_hash": "h1"}
    first = ledger.append([event])
    assert ledger.append([event | {"payload": {"a": 2, "b": 1}, "recorded_at": datetime(2026, 1, 2)}]) == first
    assert ledger.all().count() == 1 and ledger.get(first[0])["recorded_at"] == datetime(2026, 1, 2) and ledger.get("none") is None
    assert ledger.expired("h2").count() == 1 and ledger.expired("h1").count() == 0 and ledger.lineage().first().kind == "uses"


def test_calibration(spark):
    df = spark.createDataFrame([("c", "match")] * 3 + [("c", "miss")] * 17 + [("d", "match")], "class string, delta string")
    got = {r["class"]: r for r in calibration.aggregate(df, "class").collect()}
    assert got["c"].match_rate == 0.15 and 0.05 < got["c"].match_low < 0.06 and got["d"].match_high == 1.0
    assert [r["class"] for r in calibration.proposals(calibration.aggregate(df, "class")).collect()] == ["c"]
    rules_ = spark.createDataFrame([("rev*", "t1"), ("a?t", "t2")], "pattern string, target_term string")
    asked = spark.createDataFrame([(1, "revenue", "x"), (2, "cost", "act"), (3, "cost", "x")], "decision_id int, term string, action string")
    assert sorted(map(tuple, calibration.advised(asked, rules_).collect())) == [(1, "t1"), (2, "t2")]
    assert calibration.drift({"tier": 1}, {"tier": 2}) == ["tier"] and calibration.overlay({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert packs.tier_bar("pricing:raise", [("pricing:", "experimental")]) == "experimental" and packs.matches("abc", "a*") and not packs.matches("abc", "b*")


def test_trust(spark):
    terms = spark.createDataFrame([("a", True, True, date(2026, 1, 1), 30), ("b", True, False, date(2026, 1, 1), 30), ("c", False, True, date(2026, 1, 1), 30), ("d", True, True, date(2025, 1, 1), 30), ("e", True, True, None, 30), ("f", True, True, date(2025, 12, 10), 30)], "term_id string, certified boolean, probe_ok boolean, verified_on date, max_age_days int")
    got = {r.term_id: (r.drift, r.evidence_tier, r.status) for r in trust.trust_signals(terms, "2026-01-05").collect()}
    assert got == {"a": ("current", 3, "trusted"), "b": ("current", 2, "usable_with_caveats"), "c": ("current", 1, "not_usable"), "d": ("expired", 3, "not_usable"), "e": ("expired", 3, "not_usable"), "f": ("at_risk", 3, "usable_with_caveats")}


def test_events_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("1", "schema_changed", "m:a", datetime(2026, 1, 1)), ("2", "gossip", "m:a", datetime(2026, 1, 1))], "event_id string, kind string, ref string, at timestamp")
    events.write.parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("t", ["m:a"])], "term_id string, refs array<string>")
    stream = touched_terms(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), terms)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", "schema_changed", "t")]


def test_catalog_export_never_replaces_authored_edges(spark, tmp_path):
    entities = [
        {"urn": "a", "glossaryTerm": "revenue", "related": ["table:x", "table:y", None], "owner": "finance"},
        {"urn": "a", "glossaryTerm": "revenue", "related": ["table:y"], "owner": ""},
        {"urn": "b", "glossaryTerm": "unknown", "related": ["table:z"]}, {"urn": "c"}, {"urn": "d", "glossaryTerm": "orders", "owner": "sales"},
    ]
    terms = spark.createDataFrame([("revenue",), ("orders",), ("orders",)], "term_id string")
    authored = spark.createDataFrame([("revenue", "table:x", "reads")], "from_id string, to_id string, kind string")
    for name, whole in (("list", entities), ("object", {"entities": entities})):
        (tmp_path / name).write_text(json.dumps(whole))
        edges, clashes = ingest.ingested(authored, ingest.read_export(spark, str(tmp_path / name)), terms)
        made = {("revenue", "table:x", "reads"), ("revenue", "table:y", "catalog_related"), ("revenue", "owner:finance", "catalog_related"), ("orders", "owner:sales", "catalog_related")}
        assert sorted(map(tuple, edges.collect())) == sorted(made)
        assert list(map(tuple, clashes.collect())) == [("revenue", "table:x")]
    edges, clashes = ingest.ingested(authored, ingest.read_export(spark, str(tmp_path / "list")).limit(0), terms)
    assert edges.count() == 1 and clashes.count() == 0


def test_proposals_are_decided_once(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    scored = spark.createDataFrame([("revenue", "miss")] * 12 + [("orders", "match")] * 12 + [("buyers", "miss")] * 3, "term string, delta string")
    [made] = proposals.propose(book, calibration.aggregate(scored, "term"), datetime(2024, 1, 1))
    assert proposals.overrides(book) == {}
    for bad, code in ((("art-none", "approved"), "proposal_unknown"), ((made, "perhaps"), "verdict_unknown")):
        with pytest.raises(Refusal) as e:
            proposals.decide(book, *bad, "me", datetime(2024, 1, 2))
        assert e.value.code == code
    proposals.decide(book, made, "approved", "me", datetime(2024, 1, 2))
    assert proposals.overrides(book) == {"revenue": {"certified": False}}
    with pytest.raises(Refusal) as e:
        proposals.decide(book, made, "rejected", "me", datetime(2024, 1, 3))
    assert e.value.code == "proposal_decided" and proposals.propose(book, calibration.aggregate(scored.limit(0), "term"), datetime(2024, 1, 4)) == []


def test_certification_commands(spark, sf, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    n = compile_metric(catalog.kernel(), lambda t: catalog.contract(sf).table(spark, t), catalog.kernel().metrics["order_count"]).df.first()
    golden = {"order_count": [{"request": {}, "expected": n.asDict()}]}
    (tmp_path / "golden").write_text(json.dumps(golden))
    run = lambda *a: certification.main(a)
    assert run("certify", "--data", sf, "--golden", at("golden"), "--out", at("made")) == 0
    assert run("verify", "--certificates", at("made")) == 0
    wrong = json.loads((tmp_path / "made").read_text())
    (tmp_path / "old").write_text(json.dumps([{**wrong[0], "definition_hash": "other"}]))
    assert run("verify", "--certificates", at("old")) == 1
    golden["order_count"][0]["expected"] = {next(iter(n.asDict())): -1}
    (tmp_path / "golden").write_text(json.dumps(golden))
    assert run("certify", "--data", sf, "--golden", at("golden"), "--out", at("made")) == 1
    spark.createDataFrame([("revenue", "miss")] * 12, "term string, delta string").write.parquet(at("scored"))
    capsys.readouterr()
    assert run("propose", "--scored", at("scored"), "--ledger", at("ledger")) == 0
    [made] = json.loads(capsys.readouterr().out)["proposals"]
    assert run("approve", made, "--ledger", at("ledger")) == 0 and run("reject", made, "--ledger", at("ledger")) == 1
    (tmp_path / "terms").write_text(json.dumps({"revenue": {"name": "Revenue", "collection": "shop", "metrics": ["final_sales"], "certified": True}}))
    assert run("export", "--out", at("model"), "--terms", at("terms"), "--ledger", at("ledger")) == 0
    assert [t["term_id"] for t in json.loads((tmp_path / "model").read_text())["terms"]] == ["revenue"]


def packets(spark, *names):
    """One packet with every kind of hole under each name."""
    claims = [("c1", ["e1"], ["w.orders", "w"]), ("c2", ["e9", "e2"], ["w"]), ("c3", [], ["w"]), ("c4", None, None), ("c5", ["e3"], ["x"]), ("c5", ["e3", "d1"], ["y.z"])]
    cites = [
        ("e1", "atomic", "w", "p1", [], True), ("e2", "atomic", "w", "p9", [], False), ("e3", "atomic", "y", "p2", [], True), ("e3", "atomic", "y", None, [], True),
        ("d1", "derived", "f", None, ["e1", "e8"], True), ("d2", "derived", "f", "p7", None, None), ("o1", "other", "w", "p1", [], True), ("o2", None, "w", "p8", [], True),
    ]
    envelopes = [("p1", "w", "h1"), ("p2", "w", "h1"), ("p3", "w", "h0")]
    make = lambda rows, schema: spark.createDataFrame([(n, *r) for n in names for r in rows], f"packet string, {schema}")
    return (
        make(claims, "claim_id string, evidence_ids array<string>, source_ids array<string>"),
        make(cites, "evidence_id string, kind string, source_id string, provenance_id string, supporting_evidence_ids array<string>, may_support_claims boolean"),
        make(envelopes, "provenance_id string, source_id string, contract_hash string"),
    )


HOLES = sorted([
    ("duplicate_claim_id", "c5", ""), ("claim_without_evidence", "c3", ""), ("claim_without_evidence", "c4", ""), ("evidence_not_found", "c2", "e9"), ("evidence_not_claim_supporting", "c2", "e2"), ("duplicate_evidence_id", "e3", ""),
    ("unknown_citation_kind", "o1", "other"), ("unknown_citation_kind", "o2", None), ("provenance_missing", "e3", ""), ("provenance_not_found", "e2", "p9"), ("source_mismatch", "e3", "w"), ("derived_without_support", "d2", ""),
    ("supporting_evidence_not_found", "d1", "e8"), ("source_not_covered", "c3", "w"), ("source_not_covered", "c5", "x"), ("contract_hash_mismatch", "p3", "h0"),
], key=str)


def test_closure_finds_every_hole_of_a_packet(spark):
    got = closure_issues(*(df.drop("packet") for df in packets(spark, "a")), "h1")
    assert got.columns == ["code", "subject", "detail"] and sorted(map(tuple, got.collect()), key=str) == HOLES


def test_closure_of_many_packets_looks_up_within_each(spark):
    got = closure_issues(*packets(spark, "a", "b"), "h1", packet="packet")
    assert got.columns == ["packet", "code", "subject", "detail"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(n, *h) for n in "ab" for h in HOLES], key=str)
    claims, cites, envelopes = packets(spark, "a", "b")
    got = closure_issues(claims.where("packet = 'a' and claim_id = 'c1'"), cites.where("evidence_id = 'e1' and packet = 'b'"), envelopes.where("packet = 'a' and provenance_id <> 'p3'"), "h1", packet="packet")
    assert sorted(map(tuple, got.collect())) == [
        ("a", "evidence_not_found", "c1", "e1"), ("a", "source_not_covered", "c1", "w"), ("a", "source_not_covered", "c1", "w.orders"), ("b", "provenance_not_found", "e1", "p1"),
    ]


def test_closure_finds_nothing_for_rows_without_a_packet(spark):
    got = closure_issues(*(df.where("claim_id = 'c1'" if "claim_id" in df.columns else "evidence_id = 'e1'" if "evidence_id" in df.columns else "provenance_id = 'p1'") for df in packets(spark, None)), "h1", packet="packet")
    assert sorted((r.code, r.subject) for r in got.collect()) == [("evidence_not_found", "c1"), ("provenance_not_found", "e1"), ("source_not_covered", "c1"), ("source_not_covered", "c1")]
