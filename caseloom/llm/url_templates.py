"""URL filter: rules, and a tree of path templates for each host."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.tables import written


@dataclass(frozen=True)
class Settings:
    """`children`: a place of a path with more different segments is variable; of them only those with `share` of its pages
    stay by name. `levels`: levels of the tree after which runs of levels without a branch are taken in one step. `similar`: standard
    errors within which a branch has its siblings' share of bad pages. `smooth`: labelled pages' worth of what is expected of a
    template, added to its own pages. `purity`: smoothed share of bad pages from which a template is rejected."""
    children: int = 16
    share: float = 0.05
    levels: int = 6
    similar: float = 1.96
    smooth: float = 4.0
    purity: float = 0.9


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is `host/path`: it fits its host and
    all subdomains where the path starts with its own."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def typed(path: Column) -> Column:
    """Segments of a path with numbers and long hex words generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(
        F.regexp_replace(s, r"(?<![0-9A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?![0-9A-Fa-f])", "{hex}"), r"[0-9]+", "{num}"))


def templates(paths: DataFrame, settings: Settings) -> DataFrame:
    """(host, typed, template) of the distinct typed paths (host, typed, n, bad, good).

    Level by level, from the root of each host: segments of a variable place become `*`; then siblings whose share of
    bad pages is that of all labelled siblings, within `similar` standard errors, become one branch `+`. Siblings without
    labelled pages stay apart, as nothing says that they are alike. A host costs sums, however many pages it has."""
    at = paths.withColumn("template", F.lit("")).withColumn("level", F.lit(0))
    ended, rounds = [], 0
    while True:
        here = at.withColumn("seg", F.get("typed", F.col("level")))
        nodes = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        places = nodes.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"))
        nodes = nodes.join(places, ["host", "template"]).withColumn("to", F.when(
            (F.col("kinds") > settings.children) & (F.col("n") < F.col("all_n") * settings.share), F.lit("*")).otherwise(F.col("seg")))
        branches = nodes.groupBy("host", "template", "to").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        pooled = branches.where("bad + good > 0").groupBy("host", "template").agg(
            F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count("*").alias("labelled"))
        p = F.col("all_bad") / (F.col("all_bad") + F.col("all_good"))
        n = F.col("bad") + F.col("good")
        alike = (n > 0) & (F.col("labelled") > 1) & (
            F.abs(F.col("bad") / F.when(n > 0, n) - p) <= settings.similar * F.sqrt(p * (1 - p) / F.when(n > 0, n)))
        merged = branches.join(pooled, ["host", "template"], "left").select(
            "host", "template", "to", F.when(alike, F.lit("+")).otherwise(F.col("to")).alias("branch"))
        step = nodes.join(merged, ["host", "template", "to"]).select("host", "template", "seg", "branch")
        at = written(here.join(step, ["host", "template", "seg"], "left").select(*paths.columns, F.when(
            F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")).alias("template"),
            (F.col("level") + 1).alias("level")))
        rounds += 1
        ends = F.size("typed") <= F.col("level")
        if rounds >= settings.levels:
            ended.append(at.where(ends))
            at = at.where(~ends)
            if at.isEmpty():
                break
            at = past_runs(at)
        elif at.where(~ends).isEmpty():
            break
    for part in ended:
        at = at.unionByName(part)
    # how a path ends is part of its template: /a/* and /a are two
    return at.drop("level").withColumn("template", F.concat("template", F.lit("$"), F.size("typed")))


def past_runs(at: DataFrame) -> DataFrame:
    """The paths, each beyond the levels ahead on which its template has no branch. Such a run ends before the first place where a
    path has another segment than the longest path there; paths that only end on the way aren't branches. So rounds
    grow with the branches of the deepest path, not with its levels."""
    rest = F.slice("typed", F.col("level") + 1, F.size("typed") - F.col("level"))
    longest = at.groupBy("host", "template").agg(F.max(F.struct(F.size("typed"), rest.alias("way"))).alias("longest")).select(
        "host", "template", F.col("longest.way").alias("way"))
    compared = written(at.join(longest, ["host", "template"]).withColumn("rest", rest).withColumn(
        "other", F.array_position(F.zip_with("rest", F.slice("way", 1, F.size("rest")), lambda x, y: x == y), False)))
    runs = compared.where("other > 0").groupBy("host", "template").agg(F.min(F.col("other") - 1).cast("int").alias("run"))
    passed = F.slice("rest", 1, F.coalesce("run", F.size("rest")))
    return written(compared.join(runs, ["host", "template"], "left").select(
        *[c for c in at.columns if c not in ("template", "level")],
        F.concat("template", F.array_join(F.transform(passed, lambda s: F.concat(F.lit("/"), s)), "")).alias("template"),
        (F.col("level") + F.coalesce("run", F.size("rest"))).alias("level")))


def purities(tree: DataFrame, total: float, settings: Settings) -> DataFrame:
    """(host, template, purity): smoothed share of bad pages of each template of a host.

    What is expected of a template, before its own labelled pages, is the share of bad pages that its paths have on other hosts: a second
    tree over the paths of all hosts says which paths those are, and is itself smoothed towards `total`. A template's own pages
    never count as pages of others. Without labelled pages of its own, a template is rejected by what they say of it elsewhere."""
    over = tree.groupBy("typed").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]).select(F.lit("").alias("host"), "typed", "n", "bad", "good")
    shapes = templates(written(over), settings).select("typed", F.col("template").alias("shape"))
    cells = written(tree.join(shapes, "typed").groupBy("host", "template", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]))
    of_host = cells.groupBy("host", "shape").agg(F.sum("bad").alias("own_bad"), F.sum("good").alias("own_good"))
    everywhere = of_host.groupBy("shape").agg(F.sum("own_bad").alias("all_bad"), F.sum("own_good").alias("all_good"))
    bad, good = F.col("all_bad") - F.col("own_bad"), F.col("all_good") - F.col("own_good")
    expected = of_host.join(everywhere, "shape").select("host", "shape", (
        (bad + settings.smooth * total) / (bad + good + settings.smooth)).alias("expected"))
    sums = cells.join(expected, ["host", "shape"]).groupBy("host", "template").agg(
        F.sum("bad").alias("b"), F.sum("good").alias("g"), (F.sum(F.col("n") * F.col("expected")) / F.sum("n")).alias("before"))
    return sums.select("host", "template", (
        (F.col("b") + settings.smooth * F.col("before")) / (F.col("b") + F.col("g") + settings.smooth)).alias("purity"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row. The verdict is the rule's; without a rule,
    `block` if the page's template is rejected, else `allow`.

    A page is labelled by `labels` (page_id, bad 0/1), else by its rule. Purity is smoothed towards the purity of the same
    paths on other hosts, and that towards the overall share of bad pages, a half at most. Null urls, and those without ://, have an empty host and path and no template but the empty
    one. Repeated rows are judged alike and all stay; of rules of equal length the later one in the list wins. An empty table gives no
    rows. Other columns are not read."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("decided", verdict)
    bad = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    if labels is not None:
        known = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("int").alias("_bad"))
        rows, bad = rows.join(known, "page_id", "left"), F.coalesce("_bad", bad)
    rows = written(rows.withColumn("bad", bad).withColumn("typed", typed(F.col("path"))).drop("_bad"))
    paths = rows.groupBy("host", "typed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"))
    tree = written(templates(written(paths), settings))
    total = tree.agg(F.least(F.coalesce(F.sum("bad") / F.when(F.sum(F.col("bad") + F.col("good")) > 0, F.sum(F.col("bad") + F.col("good"))), F.lit(0.0)), F.lit(0.5))).first()[0]
    by_template = purities(tree, float(total or 0.0), settings)
    verdicts = written(tree.select("host", "typed", "template").join(by_template, ["host", "template"]))
    return rows.join(verdicts, ["host", "typed"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("purity") >= settings.purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", F.round("purity", 6).alias("purity"))
