"""URL filter: given rules, and for all other urls a path-template tree per host.

All steps are DataFrame operations.

1. A url's path is cut into segments; runs of digits become ``#`` and long
   hexadecimal names ``{id}``. Pages are counted by host and these segments,
   with how many of them a rule allows and how many it blocks. Only this table
   goes through the tree, so a host's copies meet in partial sums.
2. The tree is walked twice, a level at a time from the host down. Below a
   node with many different segments that are rarely repeated, or of which most
   have a small share, the segment is a variable one and becomes ``*``. The first walk does only that, so that the
   second one compares branches by what follows with variable segments
   generalised. There, sibling branches with the same profile are merged: a
   profile is the set of what follows with its share in quarters, so two
   branches are similar if each share differs by less than a quarter. If all
   that follows is too rare for that, the next segments alone are the profile.
3. Of each template, the share of blocked pages among those that a rule
   decides is smoothed toward one half, so a template that no rule reaches is
   never rejected and one with few such pages rarely. A template is rejected
   from ``REJECT`` on.

Segments below ``DEPTH`` are one branch ``**``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed, look_up

DEPTH = 6
#: A node's segments are variable if it has so many and this few pages for each, or this share of them are rare.
WILD_SEGMENTS, WILD_PAGES, WILD_RARE = 8, 2.0, 0.75
#: Branches with fewer pages are not merged.
MERGE_PAGES = 8
#: How many decided pages the prior share of one half is worth, and the share from which a template is rejected.
PRIOR_PAGES, REJECT = 4.0, 0.8

#: Rules (verdict, host, path prefix): a rule fits its host and all its subdomains.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a url; both empty for a null url
    or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments with digits and hexadecimal names generalised."""
    cut = F.split(F.regexp_replace(path, r"^/", ""), "/")
    return F.transform(cut, lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{id}")).otherwise(F.regexp_replace(s, r"[0-9]+", "#")))


def _variable(branch: DataFrame, node: list[str]) -> DataFrame:
    """(*node, wild) of branch (*node, seg, pages): the nodes whose segments are variable.

    A segment is rare if its pages are at most one in WILD_SEGMENTS - 1 of those
    that all but the most frequent segment have. So neither one hot segment nor
    more pages with the same shares change what is rare.
    """
    whole = branch.groupBy(*node).agg(F.count(F.lit(1)).alias("segments"), F.sum("pages").alias("total"), F.max("pages").alias("most"))
    many = whole.where(F.col("segments") >= WILD_SEGMENTS)
    rare = F.col("pages") * (WILD_SEGMENTS - 1) <= F.col("total") - F.col("most")
    known = branch.join(many, node).groupBy(*node).agg((
        (F.count_if(rare) >= WILD_RARE * F.count(F.lit(1))) | (F.sum("pages") < WILD_PAGES * F.count(F.lit(1)))).alias("wild"))
    return known.where("wild")


def _generalised(counts: DataFrame, depth: int) -> DataFrame:
    """counts (host, shape, segs, n) with ``*`` for the variable segments of the tree before any merge."""
    state = counts.select("host", "shape", "segs", "n")
    for level in range(depth):
        node = ["host", "prefix"]
        here = state.withColumn("prefix", F.array_join(F.slice("segs", 1, level), "/")).withColumn("seg", F.try_element_at("segs", F.lit(level + 1)))
        branch = here.where("seg IS NOT NULL").groupBy(*node, "seg").agg(F.sum("n").alias("pages"))
        variable = _variable(branch, node)
        put = F.transform("segs", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))
        state = checkpointed(look_up(here, checkpointed(variable), node, "left").select("host", "shape", F.when(F.col("wild"), put).otherwise(F.col("segs")).alias("segs"), "n"))
    return state


def _profile(follow: DataFrame, branch: DataFrame, keys: list[str], what: str) -> DataFrame:
    """(*keys, profile): what follows a branch with a share of an eighth or more, at most eight of
    them; no row for a branch without any."""
    share = F.round(4 * F.col("n") / F.col("pages")).cast("int")
    return follow.groupBy(*keys, what).agg(F.sum("n").alias("n")).join(branch, keys).withColumn("share", share).where("share > 0").groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col(what), "share")))).alias("profile"))


def templates(counts: DataFrame) -> DataFrame:
    """(host, shape, template) of counts (host, shape, segs, n): the walk down the tree.

    shape is the segments joined by ``/``; template has a ``*`` for a variable
    segment, and the least name of those merged for a merged one.
    """
    deepest = counts.agg(F.max(F.size("segs"))).first()[0] or 0
    depth = min(deepest, DEPTH)
    state = _generalised(counts, depth).withColumn("template", F.lit(""))
    for level in range(depth):
        tail = F.array_join(F.slice("segs", level + 2, DEPTH), "/")
        here = state.withColumn("seg", F.try_element_at("segs", F.lit(level + 1))).withColumn("tail", tail)
        here = here.withColumn("next", F.coalesce(F.try_element_at("segs", F.lit(level + 2)), F.lit("")))
        node = ["host", "template"]
        inner = here.where("seg IS NOT NULL")
        follow = inner.groupBy(*node, "seg", "next", "tail").agg(F.sum("n").alias("n"))
        branch = follow.groupBy(*node, "seg").agg(F.sum("n").alias("pages"))
        whole = _profile(follow, branch, [*node, "seg"], "tail")
        coarse = _profile(follow, branch, [*node, "seg"], "next").withColumnRenamed("profile", "coarse")
        alone = F.concat(F.lit("="), "seg")
        key = F.when(F.col("pages") >= MERGE_PAGES, F.coalesce("profile", "coarse", alone)).otherwise(alone)
        # every branch has a name, also one that nothing follows often enough for a profile
        keyed = branch.join(whole, [*node, "seg"], "left").join(coarse, [*node, "seg"], "left").select(*node, "seg", key.alias("profile"))
        merged = keyed.groupBy(*node, "profile").agg(F.min("seg").alias("name"))
        named = keyed.join(merged, [*node, "profile"]).join(_variable(branch, node), node, "left").select(
            *node, "seg", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("name")).alias("name"))
        step = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        state = checkpointed(here.join(named, [*node, "seg"], "left").select("host", "shape", "segs", "n", step.alias("template")))
    end = F.when(F.size("segs") > DEPTH, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return state.select("host", "shape", end.alias("template"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) of every page.

    verdict: the longest rule's; for a page that no rule decides, ``block`` if
    its template is rejected and else ``allow``. template and purity (the
    smoothed blocked share) are null for pages that a rule decides. A url that
    is null or has no ``://`` has an empty host and path, which are a host and a
    path like any others. Null and repeated ids pass through; other columns
    are not read.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("id", "host", "path", text.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("segs"))
    own = own.withColumn("shape", F.array_join("segs", "/"))
    counts = checkpointed(own.groupBy("host", "shape").agg(
        F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"),
        F.count("ruled").alias("labelled")))
    of_page = templates(counts)
    both = counts.select("host", "shape", "blocked", "labelled").join(of_page, ["host", "shape"])
    purity = (F.sum("blocked") + PRIOR_PAGES / 2) / (F.sum("labelled") + PRIOR_PAGES)
    per_template = both.groupBy("host", "template").agg(purity.alias("purity"))
    # only shapes with a page that no rule decides are looked up
    wanted = both.join(per_template, ["host", "template"]).join(counts.where("labelled < n").select("host", "shape"), ["host", "shape"], "left_semi")
    open_pages = own.where("ruled IS NULL").join(wanted.select("host", "shape", "template", "purity"), ["host", "shape"])
    columns = [F.col("id").alias(id_col), "host", "path", "rule"]
    decided = own.where("ruled IS NOT NULL").select(*columns, F.col("ruled").alias("verdict"), F.lit(None).cast("string").alias("template"),
                                                    F.lit(None).cast("double").alias("purity"))
    judged = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return decided.unionByName(open_pages.select(*columns, judged.alias("verdict"), "template", "purity"))
