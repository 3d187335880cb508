"""Queries of the term language over the graph of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.kb import KnowledgeBase

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _id(tag: int, key: str) -> str:
    return f"'Q' || ({tag}000000000 + {key})"


def _add(name: str, sql: str, ask: Callable[[KnowledgeBase], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: ask(KnowledgeBase.from_tables(spark, d))
    ORACLE[name] = sql


EUROPE = "Q1000000003"
_EUROPE = "(@exists (x:e) (exists (y:e z:e) (and (wdt:P2 x y) (and (wdt:P4 y z) (wd:Q1000000003 z)))))"
_add("kb_select_region_customers",
     f"SELECT DISTINCT {_id(3, 'c_custkey')} AS x0 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
     lambda kb: kb.query(_EUROPE, None))
_add("kb_pred_binary", f"SELECT DISTINCT {_id(3, 'c_custkey')} AS x0, {_id(2, 'c_nationkey')} AS x1 FROM customer",
     lambda kb: kb.query("(@exists (x:e y:e) (wdt:P2 x y))", None))
_add("kb_pred_unary", f"SELECT '{EUROPE}' AS x0", lambda kb: kb.query(f"(@exists (x:e) (wd:{EUROPE} x))", None))
_add("kb_swap", f"SELECT DISTINCT {_id(2, 'c_nationkey')} AS x0, {_id(3, 'c_custkey')} AS x1 FROM customer",
     lambda kb: kb.query("(@exists (x:e y:e) (SWAP wdt:P2 x y))", None))
_add("kb_join_chain", f"SELECT DISTINCT {_id(6, 'o_orderkey')} AS x0 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
     lambda kb: kb.query(f"(@exists (x:e) (JOIN wdt:P5 (JOIN wdt:P2 (JOIN wdt:P4 wd:{EUROPE})) x))", None))
_add("kb_and_intersect",
     f"SELECT {_id(2, 'c_nationkey')} AS x0 FROM customer INTERSECT SELECT {_id(2, 's_nationkey')} FROM supplier",
     lambda kb: kb.query("(@exists (x:e) (AND (lambda (n:e) (exists (y:e) (wdt:P2 y n))) (lambda (n:e) (exists (y:e) (wdt:P3 y n))) x))", None))
_add("kb_or_union",
     f"SELECT {_id(3, 'c_custkey')} AS x0 FROM customer WHERE c_nationkey = 1 UNION SELECT {_id(4, 's_suppkey')} FROM supplier WHERE s_nationkey = 1",
     lambda kb: kb.query("(@exists (x:e) (OR (JOIN wdt:P2 wd:Q2000000001) (JOIN wdt:P3 wd:Q2000000001) x))", None))
_add("kb_or_partial_binding",
     f"SELECT {_id(3, 'c_custkey')} AS x0, {_id(2, 'c_nationkey')} AS x1 FROM customer UNION SELECT {_id(4, 's_suppkey')}, NULL FROM supplier",
     lambda kb: kb.query("(@exists (x:e y:e) (or (wdt:P2 x y) (exists (z:e) (wdt:P3 x z))))", None))
_add("kb_not_anti", f"SELECT {_id(3, 'c_custkey')} AS x0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
     lambda kb: kb.query("(@exists (x:e) (and (exists (c:e) (and (wdt:P1 x c) (wd:Q3 c))) (not (exists (y:e v:num) (and (wdt:P5 y x) (and (wdt:P9 y v) (> v 300000)))))))", None))
_add("kb_ask_true", "SELECT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3) AS answer", lambda kb: kb.ask(_EUROPE))
_add("kb_ask_false", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 77) AS answer", lambda kb: kb.ask("(exists (x:e y:e) (and (wdt:P4 x y) (wd:Q1000000077 y)))"))
_add("kb_count_bag", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
     lambda kb: kb.count(f"(exists (x:e) (@exists (y:e) (and (wdt:P2 x y) (exists (z:e) (and (wdt:P4 y z) (wd:{EUROPE} z))))))"))
_add("kb_count_distinct", "SELECT count(DISTINCT c_nationkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
     lambda kb: kb.count_distinct(f"(exists (x:e) (@exists (y:e) (and (wdt:P2 x y) (exists (z:e) (and (wdt:P4 y z) (wd:{EUROPE} z))))))"))
_add("kb_multi_answer", f"SELECT DISTINCT {_id(3, 'c_custkey')} AS x0, {_id(1, 'n_regionkey')} AS x1 FROM customer JOIN nation ON c_nationkey = n_nationkey",
     lambda kb: kb.query("(@exists (x:e z:e) (exists (y:e) (and (wdt:P2 x y) (wdt:P4 y z))))", None))
_VALUE = "(@exists (x:e v:num) (wdt:P9 x v))"
for _name, _dir, _k, _off in (("kb_argmax", "DESC", 1, 0), ("kb_argmin", "ASC", 1, 0), ("kb_topk_offset", "DESC", 10, 5)):
    _add(_name, f"SELECT {_id(6, 'o_orderkey')} AS x0, o_totalprice AS x1 FROM orders ORDER BY x1 {_dir}, x0 LIMIT {_k} OFFSET {_off}",
         lambda kb, k=_k, off=_off, big=_dir == "DESC": kb.top(_VALUE, k, off, big))
_add("kb_filter_num", f"SELECT {_id(3, 'c_custkey')} AS x0 FROM customer WHERE c_acctbal * 2 > 9000.5",
     lambda kb: kb.query("(@exists (x:e) (exists (v:num c:e) (and (wdt:P8 x v) (and (> (* v 2) 9000.5) (and (wdt:P1 x c) (wd:Q3 c))))))", None))
_add("kb_filter_date", f"SELECT {_id(6, 'o_orderkey')} AS x0 FROM orders WHERE CAST(o_orderdate AS date) >= DATE '1997-01-01'",
     lambda kb: kb.query("(@exists (x:e) (exists (v:d) (and (wdt:P10 x v) (>= v 1997-01-01))))", None))
_add("kb_filter_str", f"SELECT {_id(2, 'n_nationkey')} AS x0 FROM nation WHERE n_name < 'NATION_2'",
     lambda kb: kb.query('(@exists (x:e) (exists (v:s c:e) (and (wdt:P11 x v) (and (< v "NATION_2") (and (wdt:P1 x c) (wd:Q2 c))))))', None))
_add("kb_labels", "SELECT 'Q' || (2000000000 + n_nationkey) AS x0, n_name AS x0_label FROM nation",
     lambda kb: kb.query("(@exists (x:e) (exists (y:e) (wdt:P4 x y)))", None, with_labels=True))
_add("kb_limit", f"SELECT {_id(3, 'c_custkey')} AS x0 FROM customer ORDER BY x0 LIMIT 20", lambda kb: kb.query("(@exists (x:e) (exists (y:e) (wdt:P2 x y)))", 20))
