"""URL filters: fixed rules, and for all other pages a path-template tree a host. DataFrame functions only.

Paths are cut into segments and collapsed to distinct shapes a host (runs of digits, hexadecimal and mixed ids are classes
at once), with the pages and the labels of each. Then the tree grows from the root, a level a round:

* children that hold less than RARE of a parent with more than FEW children become one wildcard, so at most FEW + 1/RARE remain;
* siblings are folded, heaviest first, into the first earlier branch that they do not differ from statistically: neither in
  how their pages' rests are shaped (a histogram of 8 bins) nor in the labels' rate; merged branches grow on as one.

A finished template is rejected if its smoothed purity, the share of blocked among labelled pages, reaches PURE. It is pulled
towards its host's rate and that towards the rate of all, by PRIOR pages each; pages without a label count as allowed by the
weight UNKNOWN. Labels are the rules' own verdicts unless a table of them is given.

Counts are summed before each shuffle and joins are with tables of branches, sent to all tasks where their checked size
allows and otherwise joined so that Spark splits hot keys; only per-parent lists of at most FEW + 1/RARE branches are gathered.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged like any other; repeated rows are
each judged and each counted; null page_ids are kept; an empty table gives no rows; columns other than page_id and url are
ignored. Segments beyond DEPTH are one segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut

DEPTH, FEW, RARE, BINS = 6, 10, 0.02, 8
PURE, PRIOR, UNKNOWN, LEAST_BLOCKED = 0.8, 2.0, 0.25, 3
#: Distance of two histograms, and standard errors of a rate, up to which siblings are alike.
NEAR, ERRORS = 0.25, 2.0
#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.regexp_extract(url, URL, 1), CAPITALS, SMALL).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments as classes where they look like ids, else as they are; at most DEPTH."""

    def classed(s: Column) -> Column:
        end = F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,5})$", 1)
        stem = F.when(end != "", F.substring(s, F.lit(1), F.length(s) - F.length(end))).otherwise(s)
        return F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("<n>"), end)).when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.concat(F.lit("<x>"), end)).when((F.length(stem) >= 12) & stem.rlike("[0-9]"), F.concat(F.lit("<id>"), end)).otherwise(s)

    every = F.split(F.regexp_replace(path, "^/", ""), "/")
    deep = F.concat(F.slice(every, 1, DEPTH - 1), F.array(F.array_join(F.slice(every, DEPTH, 1_000_000_000), "/")))
    return F.transform(F.when(F.size(every) > DEPTH, deep).otherwise(every), classed)


def counted(n: str = "n") -> list[Column]:
    return [F.sum(c).alias(c) for c in (n, "labelled", "blocked")]


def shapes(pages: DataFrame) -> DataFrame:
    """host, shape (classed segments) with pages n, labelled and blocked. pages: host, path, label."""
    known = F.col("label").isNotNull().cast("long")
    return pages.groupBy("host", segments(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.sum(known).alias("labelled"), F.sum(known * (F.col("label") == "block").cast("long")).alias("blocked")).fillna(0, ["labelled", "blocked"])


def alike(a: Column, b: Column) -> Column:
    """Whether a branch b may join a: close histograms, up to what so few pages let them differ by chance, and rates within ERRORS standard errors."""

    def share(x: Column, k: int) -> Column:
        return F.get(x["bins"], F.lit(k)) / x["n"]

    apart = reduce(lambda s, k: s + F.abs(share(a, k) - share(b, k)), range(BINS), F.lit(0.0)) / 2
    chance = F.sqrt(F.lit(1.0) / a["n"] + F.lit(1.0) / b["n"])
    both = a["labelled"] + b["labelled"]
    rate = (a["blocked"] + b["blocked"]) / F.greatest(both, F.lit(1))
    error = F.sqrt(rate * (1 - rate) * (1 / F.greatest(a["labelled"], F.lit(1)) + 1 / F.greatest(b["labelled"], F.lit(1))))
    rates = F.abs(a["blocked"] / F.greatest(a["labelled"], F.lit(1)) - b["blocked"] / F.greatest(b["labelled"], F.lit(1)))
    return (apart <= NEAR + chance) & ((a["labelled"] == 0) | (b["labelled"] == 0) | (rates <= ERRORS * error))


BRANCH = "name: string, members: array<string>, n: bigint, labelled: bigint, blocked: bigint, bins: array<bigint>"


def merged(siblings: Column) -> Column:
    """Folds siblings (heaviest first) into branches: each joins the first branch that it is like, else begins one."""

    def add(out: Column, s: Column) -> Column:
        fits = F.transform(out, lambda b: alike(b, s))
        at = F.array_position(fits, True)

        def joined(b: Column, i: Column) -> Column:
            new = F.struct(
                b["name"].alias("name"), F.concat(b["members"], s["members"]).alias("members"), (b["n"] + s["n"]).alias("n"), (b["labelled"] + s["labelled"]).alias("labelled"),
                (b["blocked"] + s["blocked"]).alias("blocked"), F.zip_with(b["bins"], s["bins"], lambda x, y: x + y).alias("bins"),
            )
            return F.when(i + 1 == at, new).otherwise(b)

        return F.when(at > 0, F.transform(out, joined)).otherwise(F.concat(out, F.array(s)))

    none = F.from_json(F.lit("[]"), f"array<struct<{BRANCH}>>")
    return F.aggregate(siblings, none, add)


def level(rows: DataFrame, d: int) -> DataFrame:
    """rows (host, node, shape, counts) with node one level deeper where the shape goes on."""
    going = rows.where(F.size("shape") > d).withColumn("child", F.get("shape", F.lit(d)))
    rest = F.transform(F.slice("shape", d + 2, DEPTH), lambda s: F.when(s.startswith("<"), s).otherwise("w"))
    bin_ = F.pmod(F.xxhash64(F.array_join(rest, "/")), F.lit(BINS))
    children = cut(going.withColumn("bin", bin_).groupBy("host", "node", "child").agg(*counted(), *[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)).alias(f"b{k}") for k in range(BINS)]))
    parents = children.groupBy("host", "node").agg(F.count("*").alias("width"), F.sum("n").alias("whole"))
    named = children.join(beside(parents), ["host", "node"]).withColumn("kept", F.when((F.col("width") > FEW) & (F.col("n") < RARE * F.col("whole")), "*").otherwise(F.col("child")))
    pooled = named.groupBy("host", "node", "kept").agg(*counted(), *[F.sum(f"b{k}").alias(f"b{k}") for k in range(BINS)])
    one = F.struct((-F.col("n")).alias("order"), F.col("kept").alias("name"), F.array("kept").alias("members"), "n", "labelled", "blocked", F.array(*[f"b{k}" for k in range(BINS)]).alias("bins"))
    siblings = pooled.groupBy("host", "node").agg(F.array_sort(F.collect_list(one)).alias("siblings"))
    plain = F.transform("siblings", lambda s: F.struct(*[s[c].alias(c) for c in ("name", "members", "n", "labelled", "blocked", "bins")]))
    branches = siblings.select("host", "node", F.explode(merged(plain)).alias("b")).select("host", "node", F.explode("b.members").alias("kept"), F.array_join(F.array_sort("b.members"), "|").alias("branch"))
    # every child with its branch's name; a branch of its own keeps its name
    to = named.select("host", "node", "child", "kept").join(beside(branches), ["host", "node", "kept"]).select("host", "node", "child", "branch")
    deeper = going.join(beside(cut(to)), ["host", "node", "child"]).select("host", F.concat_ws("/", "node", "branch").alias("node"), "shape", "n", "labelled", "blocked")
    return rows.where(F.size("shape") <= d).unionByName(deeper)


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, template, rejected of every shape. pages: host, path, label (block, allow or null)."""
    rows = cut(shapes(pages).withColumn("node", F.lit("")))
    d = 0
    while rows.where(F.size("shape") > d).limit(1).count():
        rows = cut(level(rows, d))
        d += 1

    def rate(blocked: Column, labelled: Column, n: Column, prior: Column) -> Column:
        return (blocked + PRIOR * prior) / (labelled + UNKNOWN * (n - labelled) + PRIOR)

    of = [F.col("blocked"), F.col("labelled"), F.col("n")]
    tree = rows.groupBy("host", "node").agg(*counted())
    hosts = tree.groupBy("host").agg(*counted())
    whole = hosts.agg(*counted()).select(F.coalesce(rate(*of, F.lit(0.5)), F.lit(0.5)).alias("all"))
    hosts = hosts.join(F.broadcast(whole)).select("host", rate(*of, F.col("all")).alias("own"))  # one row
    judged = tree.join(beside(cut(hosts)), "host").withColumn("purity", rate(*of, F.col("own")))
    judged = judged.select("host", "node", "purity", ((F.col("purity") >= PURE) & (F.col("blocked") >= LEAST_BLOCKED)).alias("rejected"))
    return rows.join(beside(cut(judged)), ["host", "node"]).select("host", "shape", F.col("node").alias("template"), "purity", "rejected")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. labels: page_id, label (block or allow), in place of the rules' verdicts."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    seen = parsed(pages).withColumn("rule", rule).withColumn("said", verdict)
    known = seen.withColumn("label", F.col("said"))
    if labels is not None:
        own = labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("label").alias("label"))  # "block" outvotes "allow"
        known = seen.join(own, "page_id", "left")
    rejected = cut(templates(known).where("rejected").select("host", "shape", "rejected"))
    shaped = seen.withColumn("shape", segments(F.col("path")))
    found = shaped.join(beside(rejected), ["host", "shape"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))
