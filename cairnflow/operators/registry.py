"""Name -> query and name -> oracle SQL of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import run_sql
from . import catalogue, fastpath, franchise, fusion, holdout, hybrid, models, neighbours, requests, reranking, sqlmore, text, warp
from .sqlops import SQL

#: what the two engines spell differently: (in the text, for Spark, for the oracle)
DIALECT = ((" AS STRING", " AS STRING", " AS VARCHAR"), ("regexp_like(", "regexp_like(", "regexp_matches("), (" GLOBAL)", ")", ", 'g')"), ("explode(sequence(", "explode(sequence(", "unnest(generate_series("))


def _portable(body: str, oracle: bool = False) -> str:
    """count_if(x) as a count of a CASE, which is a 64-bit number in every engine, and one engine's spelling."""
    while (at := body.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += (body[end] == "(") - (body[end] == ")")
            end += 1
        body = f"{body[:at]}count(CASE WHEN {body[at + 9 : end - 1]} THEN 1 END){body[end:]}"
    for mark, spark, other in DIALECT:
        body = body.replace(mark, other if oracle else spark)
    return body


def _sql(body: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, body)


_ALL = SQL | sqlmore.SQL
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _sql(_portable(v)) for k, v in _ALL.items()} | neighbours.QUERIES | text.QUERIES | models.QUERIES | catalogue.QUERIES | reranking.QUERIES | hybrid.QUERIES | fusion.QUERIES | warp.QUERIES | requests.QUERIES | franchise.QUERIES | holdout.QUERIES | fastpath.QUERIES
ORACLES: dict[str, str] = {k: _portable(v, oracle=True) for k, v in _ALL.items()} | text.ORACLES | models.ORACLES | catalogue.ORACLES | reranking.ORACLES | requests.ORACLES | hybrid.ORACLES
