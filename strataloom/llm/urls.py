"""URL rules by host suffixes and path prefixes, with DataFrame functions only (operator 13).

A URL is expanded into expressions: each suffix of its host's labels with each prefix of its path
that a rule could have.  The expressions meet the rules in an equi-join on the first bytes of their
digests; the full digest confirms a meeting, and of the rules that fit a URL the longest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlParams:
    """``default`` judges URLs that no rule fits; ``prefix_bytes`` of a digest are the key of the join.

    ``salts`` copies of every rule spread the URLs that share an expression (all of one host, or of
    one top-level domain) over as many keys.
    """

    default: str = "allow"
    prefix_bytes: int = 4
    salts: int = 16


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """A host holds no slash and a path is empty or begins with one, so the joined text is unambiguous."""
    return F.sha2(F.concat(host, path), 256)


def _key(digest: Column, params: UrlParams) -> Column:
    return F.substring(digest, 1, 2 * params.prefix_bytes)


def compiled(rules: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """Rules of (host, path, action) with the columns of the join, one row a rule and salt.

    Hosts in lower case.  Rules without a host, or whose path neither is empty nor begins with a
    slash, fit nothing and are left out; of rules for the same place a block stays.
    """
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    each = rules.select(host.alias("rule_host"), path.alias("rule_path"), "action").where((F.col("rule_host") != "") & ((F.col("rule_path") == "") | F.col("rule_path").startswith("/")))
    one = each.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return one.select(
        F.concat("rule_host", "rule_path").alias("rule"), "action", _key(digest, params).alias("key"), digest.alias("digest"),
        F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt"),
    )


def _shape(rules: DataFrame) -> DataFrame:
    """One row: the most labels and slashes of a rule, and the lengths of paths that don't end with a slash."""
    path = F.coalesce("path", F.lit(""))
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))
    return rules.agg(
        F.coalesce(F.max(count(F.col("host"), ".")) + 1, F.lit(0)).alias("labels"), F.coalesce(F.max(count(path, "/")), F.lit(0)).alias("slashes"),
        F.collect_set(F.when(~path.endswith("/"), F.length(path))).alias("lengths"),
    )


def host_suffixes(host: Column, labels: Column) -> Column:
    """The suffixes of at most so many labels."""
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), labels)
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: k <= most), lambda k: F.array_join(F.slice(parts, -k, k), "."))


def path_prefixes(path: Column, slashes: Column, lengths: Column) -> Column:
    """The prefixes that end with one of the first slashes, and those of the lengths."""
    parts = F.split(path, "/")
    most = F.least(F.size(parts) - 1, slashes)
    ended = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: k <= most), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    cut = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.concat(ended, cut))


def judged(pages: DataFrame, rules: DataFrame, params: UrlParams = UrlParams(), url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides, else null) and verdict.

    A rule fits its host and all subdomains, if the path of the URL starts with the rule's, at a
    slash or within a segment.  The longest rule wins; of rules of the same length that with the
    longer host, as all of them end alike.  A null URL, or one without ``://``, has an empty host
    and path and the default verdict.  Every row stays, repeated ones too; columns of ``pages`` with
    the names of the new ones are replaced.  How many expressions a URL has depends on the rules'
    labels, slashes and lengths, not on the URL's length.  One shuffle of a row a URL at most: what
    a URL's expressions met is merged within the task that expanded them.
    """
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*others).alias("_page"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), F.monotonically_increasing_id().alias("_row"))
    # one row of three values, made by an aggregate
    shaped = rows.join(F.broadcast(_shape(rules)))
    suffixes, prefixes = host_suffixes(F.col("_host"), F.col("labels")), path_prefixes(F.col("_path"), F.col("slashes"), F.col("lengths"))
    expanded = shaped.select("_page", "_host", "_path", "_row", F.explode_outer(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))).alias("_digest"))
    compiled_rules = compiled(rules, params)
    met = expanded.join(
        compiled_rules,
        (_key(F.col("_digest"), params) == compiled_rules["key"]) & (F.pmod("_row", F.lit(params.salts)) == compiled_rules["salt"]),
        "left",
    )
    # a shared key is no meeting yet: the whole digests must be equal
    best = F.max(F.when(F.col("_digest") == F.col("digest"), F.struct(F.length("rule").alias("length"), F.length(F.substring_index("rule", "/", 1)).alias("host_length"), "rule", "action"))).alias("_best")
    out = met.groupBy("_row").agg(F.first("_page").alias("_page"), F.first("_host").alias("host"), F.first("_path").alias("path"), best)
    return out.select(*(F.col("_page")[c].alias(c) for c in others), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(params.default)).alias("verdict"))


def duckdb_sql(rules: list[tuple[str, str, str]], params: UrlParams = UrlParams()) -> str:
    """The same for ``pages`` and rules in valid form, by trying all rules on each URL, for DuckDB."""
    return rf"""
        WITH rules(h, p, action) AS (VALUES {", ".join(map(str, rules))}),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (
          SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (
          SELECT row, max({{'size': length(h || p), 'host': length(h), 'rule': h || p, 'action': action}}) AS best
          FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, '{params.default}') AS verdict FROM parts LEFT JOIN fits USING (row)"""
