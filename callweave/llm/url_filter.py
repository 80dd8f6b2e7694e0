"""URL filters: a trie over reversed host labels and path segments.

A rule is `host/path`. It fits its host and all subdomains of it when the path of the url
starts with the path of the rule. Of the rules that fit, the longest (host and path, in
characters) decides; of a block and an allow entry of equal text, block decides.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule
and gets the default verdict; an empty table gives an empty table; repeated rows are judged
one by one; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_column

#: Rules beyond this number are joined and not broadcast.
MAX_TRIE_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[tuple[str, str]]) -> dict:
    """rules: (verdict, host/path). A node's key None holds the path trie below its host.

    A path trie is keyed by whole segments. The last segment of a rule may be a part of the
    segment in a url, so it hangs in `tails`, keyed by its length for lookup by slices.
    """
    root: dict = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {"next": {}, "tails": {}})
        *whole, last = (slash + path).split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "tails": {}})
        held = node["tails"].setdefault(len(last), {})
        if held.get(last, ("", ""))[1] != "block":
            held[last] = (rule, verdict)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        below = node.get(None)
        for segment in segments:
            if below is None:
                break
            for length, tails in below["tails"].items():
                hit = tails.get(segment[:length])
                if hit and (best is None or len(hit[0]) > len(best[0])):
                    best = hit
            below = below["next"].get(segment)
    return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every url, by a broadcast trie."""
    if len(rules) > MAX_TRIE_RULES:
        table = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
        return judge_urls_by_join(pages, table, id_col, url_col, default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), F.struct(url_host(url).alias("host"), url_path(url).alias("path")).alias("parts"))

    def start():
        tree = trie.value

        def judge(batch):
            hosts, paths = batch.field("host"), batch.field("path")
            found = [look_up(tree, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            return [hosts, paths, [f and f[0] for f in found], [f[1] if f else default for f in found]]

        return judge

    outputs = {"host": "string", "path": "string", "rule": "string", "verdict": "string"}
    return map_column(parts, F.col("parts"), [id_col], outputs, start)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same from a table of rules of any size: (verdict, rule).

    Every url is spread over the suffixes of its host and over the prefixes of its path that
    have the length of some rule's path, joined by equality, and the longest match is kept.
    """
    split = rules.select(
        "rule",
        "verdict",
        F.substring_index("rule", "/", 1).alias("r_host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("r_path"),
    ).groupBy("r_host", "r_path", "rule").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    lengths = split.groupBy().agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"))
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    keys = (
        parts.crossJoin(F.broadcast(lengths))  # one row of distinct lengths
        .select("*", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")).alias("r_host"))
        .select("*", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")).alias("r_path"))
    )
    best = (
        keys.join(split, ["r_host", "r_path"], "left")
        .groupBy("id", "row", "host", "path")
        .agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("hit"))
    )
    missed = parts.join(best.select("row"), "row", "left_anti").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return best.select("id", "host", "path", "hit.rule", F.coalesce("hit.verdict", F.lit(default)).alias("verdict")).unionByName(missed).withColumnRenamed("id", id_col)
