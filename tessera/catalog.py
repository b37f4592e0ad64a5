"""Contract and kernel over the bundled star schema: the sources, fields, rules, relations and metrics that the queries use."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.metrics import kernel as kernels
from tessera.plans.contract import Contract, load
from tessera.sources.registry import Source, Sources

#: Table -> file and (column, name in the contract).
TABLES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "region_id", "r_name": "region_name"},
    "nation": {"n_nationkey": "nation_id", "n_name": "nation_name", "n_regionkey": "region_id"},
    "customer": {"c_custkey": "customer_id", "c_name": "customer_name", "c_nationkey": "nation_id", "c_acctbal": "account_balance", "c_mktsegment": "segment"},
    "supplier": {"s_suppkey": "supplier_id", "s_name": "supplier_name", "s_nationkey": "nation_id", "s_acctbal": "account_balance"},
    "part": {"p_partkey": "part_id", "p_name": "part_name", "p_brand": "brand", "p_type": "part_type", "p_size": "part_size", "p_retailprice": "retail_price"},
    "orders": {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "order_status", "o_totalprice": "total_price", "o_orderdate": "order_date", "o_orderpriority": "priority"},
    "lineitem": {
        "l_orderkey": "order_id", "l_partkey": "part_id", "l_suppkey": "supplier_id", "l_linenumber": "line_number", "l_quantity": "quantity", "l_extendedprice": "extended_price",
        "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag", "l_linestatus": "line_status", "l_shipdate": "ship_date",
    },
    "events": {"event_id": "event_id", "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"},
    "documents": {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"},
    "embeddings": {"vec_id": "vec_id", "embedding": "embedding", "label": "label"},
}

CONTRACT = """
# metrics

- final revenue: sum of total price from orders where order status = F.
- units sold: sum of quantity over order lines.

# rules

- active: Ignore segment BUILDING from all calculations, it is a closed programme.
- active: Customers with more than 10 late orders are under review until cleared.
- active: Revenue metrics must use final orders only unless the user explicitly asks for others.
- review: Exclude segment MACHINERY once the migration is done.

# dimensions

- warehouse.region.region_id: unique identifier for each region
- warehouse.region.region_name: display name of the region
- warehouse.nation.nation_id: unique identifier for each nation
- warehouse.nation.nation_name: display name of the nation
- warehouse.nation.region_id: region of the nation
- warehouse.customer.customer_id: unique identifier for each customer
- warehouse.customer.customer_name: display name of the customer
- warehouse.customer.nation_id: nation of the customer
- warehouse.customer.segment: market segment of the customer
- warehouse.supplier.supplier_id: unique identifier for each supplier
- warehouse.supplier.supplier_name: display name of the supplier
- warehouse.supplier.nation_id: nation of the supplier
- warehouse.part.part_id: unique identifier for each part
- warehouse.part.part_name: display name of the part
- warehouse.part.brand: brand of the part
- warehouse.part.part_type: type of the part
- warehouse.part.part_size: size of the part
- warehouse.orders.order_id: unique identifier for each order
- warehouse.orders.customer_id: identifier for the buyer of the order
- warehouse.orders.order_status: fulfillment state of the order
- warehouse.orders.order_date: calendar date of the order
- warehouse.orders.priority: priority of the order
- warehouse.lineitem.order_id: order of the line
- warehouse.lineitem.part_id: part of the line
- warehouse.lineitem.supplier_id: supplier of the line
- warehouse.lineitem.line_number: place of the line in its order
- warehouse.lineitem.return_flag: return flag of the line
- warehouse.lineitem.line_status: status of the line
- warehouse.lineitem.ship_date: calendar date of shipping
- warehouse.events.event_id: unique identifier for each event
- warehouse.events.ts: timestamp of the event
- warehouse.events.user_id: user who caused the event
- warehouse.events.event_type: kind of event
- warehouse.events.props: properties as JSON
- warehouse.documents.doc_id: unique identifier for each document
- warehouse.documents.text: body text of the document
- warehouse.documents.lang: language of the document
- warehouse.documents.source: host that the document is from
- warehouse.embeddings.vec_id: unique identifier for each vector
- warehouse.embeddings.embedding: the vector itself
- warehouse.embeddings.label: class of the vector

# measures

- warehouse.orders.total_price: monetary value of the order, default sum
- warehouse.lineitem.quantity: number of units ordered on the line, default sum
- warehouse.lineitem.extended_price: gross price of the line, default sum
- warehouse.lineitem.discount: discount rate of the line, default average
- warehouse.lineitem.tax: tax rate of the line, default average
- warehouse.customer.account_balance: balance of the customer's account, default average
- warehouse.supplier.account_balance: balance of the supplier's account, default average
- warehouse.part.retail_price: list price of the part, default average
- warehouse.events.value: value of the event, default sum
- warehouse.documents.n_chars: length of the document in characters, default average

# relations

- warehouse.orders.customer_id = warehouse.customer.customer_id
- warehouse.customer.nation_id = warehouse.nation.nation_id
- warehouse.supplier.nation_id = warehouse.nation.nation_id
- warehouse.nation.region_id = warehouse.region.region_id
- warehouse.lineitem.order_id = warehouse.orders.order_id
- warehouse.lineitem.part_id = warehouse.part.part_id
- warehouse.lineitem.supplier_id = warehouse.supplier.supplier_id
"""

KERNEL = {
    "collections": {"shop": {"priority": 100, "tenant": "shop"}, "retail": {"priority": 50, "industry": "retail"}, "common": {"priority": 10}},
    "entities": {
        "order": {"source": "warehouse", "table": "orders", "primary_key": "order_id", "time_field": "order_date"}, "line": {"source": "warehouse", "table": "lineitem", "primary_key": "order_id", "time_field": "ship_date"},
        **{t: {"source": "warehouse", "table": t, "primary_key": f"{t}_id"} for t in ("customer", "nation", "region", "part", "supplier")},
    },
    "measures": {
        "total": {"entity": "order", "field": "total_price", "aggregation": "sum"}, "orders": {"entity": "order", "field": "order_id", "aggregation": "count"}, "mean": {"entity": "order", "field": "total_price", "aggregation": "avg"},
        "least": {"entity": "order", "field": "total_price", "aggregation": "min"}, "most": {"entity": "order", "field": "total_price", "aggregation": "max"}, "buyers": {"entity": "order", "field": "customer_id", "aggregation": "count_distinct"},
        "units": {"entity": "line", "field": "quantity", "aggregation": "sum"}, "lines": {"entity": "line", "field": "order_id", "aggregation": "count"}, "shipped_orders": {"entity": "line", "field": "order_id", "aggregation": "count_distinct"},
        "balance": {"entity": "customer", "field": "account_balance", "aggregation": "sum"},
    },
    "dimensions": {
        "status": {"entity": "order", "field": "order_status"}, "priority": {"entity": "order", "field": "priority"}, "segment": {"entity": "customer", "field": "segment"}, "nation": {"entity": "nation", "field": "nation_name"},
        "region": {"entity": "region", "field": "region_name"}, "brand": {"entity": "part", "field": "brand"}, "flag": {"entity": "line", "field": "return_flag"},
    },
    "relations": {
        "line_order": {"left": "line", "right": "order", "left_key": "order_id", "right_key": "order_id"}, "order_customer": {"left": "order", "right": "customer", "left_key": "customer_id", "right_key": "customer_id"},
        "customer_nation": {"left": "customer", "right": "nation", "left_key": "nation_id", "right_key": "nation_id"}, "nation_region": {"left": "nation", "right": "region", "left_key": "region_id", "right_key": "region_id"},
        "line_part": {"left": "line", "right": "part", "left_key": "part_id", "right_key": "part_id"},
    },
    "rules": {"final": {"filters": {"order_status": "F"}}, "open": {"filters": {"order_status": "O"}}, "returned": {"filters": {"return_flag": "R"}}},
    "metrics": {
        "gross_sales": {"name": "Gross sales", "collection": "shop", "measure": "total", "dimensions": ["status", "priority", "segment", "nation", "region"], "synonyms": ["sales"], "max_age_days": 30},
        "final_sales": {"name": "Final sales", "collection": "shop", "measure": "total", "rules": ["final"], "dimensions": ["priority", "segment", "nation", "region"], "synonyms": ["revenue"], "max_age_days": 5, "sla": "hard"},
        "open_sales": {"name": "Open sales", "collection": "shop", "measure": "total", "rules": ["open"], "dimensions": ["priority", "segment"]},
        "order_count": {"name": "Orders", "collection": "shop", "measure": "orders", "dimensions": ["status", "priority", "segment", "nation", "region"]},
        "mean_order": {"name": "Mean order", "collection": "common", "measure": "mean", "dimensions": ["status", "segment"], "synonyms": ["revenue"]},
        "least_order": {"name": "Least order", "collection": "common", "measure": "least", "dimensions": ["status"]}, "most_order": {"name": "Largest order", "collection": "common", "measure": "most", "dimensions": ["status"], "status": "deprecated"},
        "buyers": {"name": "Buyers", "collection": "shop", "measure": "buyers", "dimensions": ["status", "priority", "segment"]},
        "units": {"name": "Units", "collection": "shop", "measure": "units", "dimensions": ["flag", "brand", "status", "segment", "nation", "region"]},
        "average_order": {"name": "Average order value", "collection": "shop", "formula": "measure:total / measure:orders", "dimensions": ["status", "segment", "region"], "synonyms": ["aov"]},
        "sales_per_buyer": {"name": "Sales per buyer", "collection": "shop", "formula": "metric:gross_sales / metric:buyers", "dimensions": ["status", "segment"]},
        "spread": {"name": "Spread", "collection": "shop", "formula": "measure:most - measure:least", "dimensions": ["status", "priority"]},
        "nested": {"name": "Share above least", "collection": "shop", "formula": "(metric:average_order - measure:least) / metric:spread * 100", "dimensions": ["status", "priority"]},
        "undefined": {"name": "Undefined", "collection": "common", "formula": "measure:total / (measure:orders - measure:orders)", "dimensions": ["status"]},
        "lines_per_order": {"name": "Lines per order", "collection": "shop", "formula": "measure:lines / measure:shipped_orders", "dimensions": ["flag"]},
        "balance": {"name": "Balance", "collection": "shop", "measure": "balance", "dimensions": ["segment", "status"]},
    },
}


def scan(sf_dir: str, table: str):
    """Reader of a table under its contract's names; renames don't stand in the way of pruning and pushdown."""

    def read(spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.col(c).alias(n) for c, n in TABLES[table].items()])

    return read


def sources(sf_dir: str) -> Sources:
    return Sources([Source("warehouse", "parquet", {"path": sf_dir}, {t: scan(sf_dir, t) for t in TABLES})])


def contract(sf_dir: str) -> Contract:
    return load(CONTRACT, sources(sf_dir))


@lru_cache(1)
def kernel() -> kernels.Kernel:
    return kernels.load(KERNEL)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, contract(sf_dir), kernel=kernel(), **options)
