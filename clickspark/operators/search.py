"""Click search (F11) and URL full-text search.

Tokeniser (fixed here, used by every search): lower-case, split on runs of characters other
than ``a-z`` and ``0-9``, drop empty tokens. Results are ordered by time, so no scoring.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.operators.common import prune_months, top_n_per_key, ts, with_scalar_total

TOKEN_SPLIT = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    """Token array of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != ""))


def query_tokens(q: str) -> list[str]:
    """Driver-side tokens of one query string (same rule as ``tokens``)."""
    return sorted({t for t in re.split(TOKEN_SPLIT, q.lower()) if t})


def click_search(clicks: DataFrame, short_code: str | None = None, country_code: str | None = None,
                 device: str | None = None, start=None, end=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """AND of the given exact filters and an inclusive time range (bounds cut to whole
    seconds); newest first; one page plus ``total`` = number of matching clicks."""
    cond = F.lit(True)
    if short_code:
        cond = cond & (F.col("short_code") == short_code)
    if country_code:
        cond = cond & (F.col("country_code") == country_code)
    if device:
        cond = cond & (F.col("device_type") == device)
    if start is not None:
        cond = cond & (F.col("clicked_at") >= F.date_trunc("second", ts(start)))
    if end is not None:
        cond = cond & (F.col("clicked_at") <= F.date_trunc("second", ts(end)))
    matched = prune_months(clicks, start, end).where(cond)
    page = (matched.orderBy(F.desc("clicked_at"), F.asc("event_id")).offset(offset).limit(limit)
            .select("event_id", "short_code", "clicked_at", "country_code", "device_type", "ip_address"))
    return with_scalar_total(page, matched)


def url_search(urls: DataFrame, q: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """URLs where any query token is a token of the long URL or of the code; newest
    first; one page plus the real ``total``. A single query is a map-only filter
    (``arrays_overlap`` with a literal token array): no join, no shuffle before the top-k."""
    qt = F.array(*[F.lit(t) for t in query_tokens(q)]) if query_tokens(q) else F.array().cast("array<string>")
    doc_tokens = F.array_union(tokens(F.col("long_url")), tokens(F.col("short_code")))
    matched = urls.where(F.arrays_overlap(doc_tokens, qt))
    rows = (matched.orderBy(F.desc("created_at"), F.asc("short_code")).offset(offset).limit(limit)
            .select("short_code", "long_url", "created_at"))
    return with_scalar_total(rows, matched)


def token_table(urls: DataFrame) -> DataFrame:
    """Inverted index rows ``(token, short_code, created_at)`` of the URL table."""
    doc_tokens = F.array_union(tokens(F.col("long_url")), tokens(F.col("short_code")))
    return urls.select(F.explode(doc_tokens).alias("token"), "short_code", "created_at")


def term_paths(lists: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How to count the URLs with any term of a list without writing (list, URL) pairs.

    ``lists`` are distinct lists ``_terms``, ``counts`` the URLs ``n`` of a ``token``. A list's known terms are put
    in falling order of n; the URLs with any of them are the sum of the counts, less, for every term but the first,
    its URLs that have an earlier term too. That depends on the terms up to this one alone, its path, which lists with
    the same frequent terms share: so a frequent term is gone through once for a path, not once for a list.
    Returns (``_terms``, ``_found`` number of known terms, ``_sum`` of the counts) and (``_terms``, ``_path``) for
    every term but the first."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "token")))
    known = lists.select("_terms", F.explode("_terms").alias("token")).join(counts, "token").groupBy("_terms").agg(
        F.sum("n").alias("_sum"), order["token"].alias("_order"))
    ends = F.explode(F.sequence(F.lit(2), F.size("_order")))
    several = known.where(F.size("_order") > 1).select("_terms", "_order", ends.alias("_end"))
    paths = several.select("_terms", F.slice("_order", F.lit(1), F.col("_end")).alias("_path"))
    return known.select("_terms", F.size("_order").alias("_found"), "_sum"), paths


def path_steps(paths: DataFrame) -> DataFrame:
    """Each path once: ``_path``, its last ``token`` and the terms ``_before``."""
    return paths.select("_path").distinct().select(
        "_path", F.element_at("_path", -1).alias("token"), F.slice("_path", F.lit(1), F.size("_path") - 1).alias("_before"))


def path_totals(known: DataFrame, paths: DataFrame, shared: DataFrame) -> DataFrame:
    """(``_terms``, ``total``) from ``term_paths`` and, by path, the ``_shared`` URLs of its last term that have an
    earlier one."""
    less = paths.join(shared, "_path").groupBy("_terms").agg(F.sum("_shared").alias("_less"))
    return known.join(less, "_terms", "left").select("_terms", (F.col("_sum") - F.coalesce(F.col("_less"), F.lit(0))).cast("bigint").alias("total"))


def bulk_url_search(urls: DataFrame, queries: DataFrame, per_query: int = 20, salts: int = 16) -> DataFrame:
    """F12 for a table of queries (``query_id, q``): the ``per_query`` newest URLs of each and its ``total``.

    A (query, URL) pair is written for the newest URLs of a token only. Totals are counted per distinct
    list of terms by ``term_paths``; a URL is what has one code and time. Some tokens stand in every URL, so index
    rows are spread over ``salts`` parts of a token and the few asked rows are copied to each."""
    part = F.pmod(F.xxhash64("short_code", "created_at"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", F.explode(tokens(F.col("q"))).alias("token")) \
        .groupBy("query_id").agg(F.sort_array(F.collect_set("token")).alias("_terms"))
    lists = asked.select("_terms").distinct()
    terms = lists.select(F.explode("_terms").alias("token")).distinct().withColumn("_salt", every)
    # the asked tokens of a URL are brought together: they tell which other terms it has
    docs = token_table(urls).withColumn("_salt", part).join(terms, ["token", "_salt"], "left_semi") \
        .groupBy("short_code", "created_at").agg(F.collect_set("token").alias("_tokens"))
    index = docs.select(F.explode("_tokens").alias("token"), "short_code", "created_at", "_tokens")
    known, paths = term_paths(lists, index.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    shared = path_steps(paths).withColumn("_salt", every).join(index.withColumn("_salt", part), ["token", "_salt"]) \
        .where(F.arrays_overlap("_tokens", "_before")).groupBy("_path").agg(F.count(F.lit(1)).alias("_shared"))
    newest = [F.desc("created_at"), F.asc("short_code")]
    per_token = top_n_per_key(index.drop("_tokens"), ["token"], newest, per_query)
    hits = lists.select("_terms", F.explode("_terms").alias("token")).join(per_token, "token").select("_terms", "short_code", "created_at").distinct()
    top = top_n_per_key(hits, ["_terms"], newest, per_query, rank_col="rank")
    found = top.join(path_totals(known, paths, shared), "_terms")
    return asked.join(found, "_terms").select("query_id", "short_code", "created_at", "rank", "total")
