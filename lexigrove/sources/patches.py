"""Whether unified diffs apply to files, told by joins.

A patch's lines become rows; windows over a patch tell headers from bodies by
the counts that each hunk declares. Of a hunk's old lines the one that its
file holds least often is looked up, which gives a few places where the hunk
may lie; the other lines are compared there by an equi-join on (file, line
number, text). Hunks of one file then take places in their order, each the
nearest to where it says that does not touch what an earlier one has patched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.sources.scratch import cut

_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: States of a hunk in which a patch applies.
GOOD = ("exact", "shifted")


def text_lines(text: Column) -> Column:
    """Lines of a text, each with the line feed that ends it; a text that ends with one has no line after it."""
    parts = F.split(text, "\n", -1)
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
    last = F.element_at(parts, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(last == "", ended).otherwise(F.array_append(ended, last))


def hunk_lines(patches: DataFrame, key: str = "patch_id", patch: str = "patch") -> DataFrame:
    """Every line of every patch from its first hunk header on.

    (key, hunk, pos, head, loose, body, kind, old_at, old_path, new_path, old_start,
    old_n, new_start, new_n, text): ``body`` lines are those that the header
    counts; a ``loose`` header follows neither a file header nor a hunk; ``text`` is a body line without its mark and with its line feed,
    unless the patch says that it has none; ``old_at`` is its place among the
    hunk's old lines.
    """
    lines = patches.select(key, F.posexplode(F.split(F.coalesce(F.col(patch), F.lit("")), "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    number = lambda i, none: F.coalesce(F.when(F.regexp_extract("line", _HEAD, i) != "", F.regexp_extract("line", _HEAD, i)), F.lit(none)).cast("long")
    lines = lines.withColumn("head", F.col("line").rlike(_HEAD)).withColumn("last", F.lead("line").over(w).isNull() & (F.col("line") == ""))
    lines = lines.filter("not last").withColumn("hunk", F.sum(F.col("head").cast("int")).over(w)).withColumn("next", F.lead("line").over(w))
    kind = F.when(F.col("line") == "", F.lit(" ")).otherwise(F.substring("line", 1, 1))
    lines = lines.withColumn("kind", F.when(~F.col("head"), kind))
    h = Window.partitionBy(key, "hunk").orderBy("pos")
    before = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(h.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for name, (i, none) in {"old_start": (1, "0"), "old_n": (2, "1"), "new_start": (3, "0"), "new_n": (4, "1")}.items():
        lines = lines.withColumn(name, F.first(F.when(F.col("head"), number(i, none))).over(h))
    lines = lines.withColumn("old_at", before((" ", "-"))).withColumn("new_at", before((" ", "+")))
    lines = lines.withColumn("body", (F.col("hunk") > 0) & ~F.col("head") & ((F.col("old_at") < F.col("old_n")) | (F.col("new_at") < F.col("new_n"))))

    # A file header is two lines right before a hunk; a hunk follows a header or another hunk.
    near = lambda i: F.lead("line", i).over(w) if i > 0 else F.lag("line", -i).over(w)
    old = ~F.col("body") & F.col("line").startswith("--- ") & near(1).startswith("+++ ") & near(2).rlike(_HEAD)
    new = ~F.col("body") & F.col("line").startswith("+++ ") & near(-1).startswith("--- ") & near(1).rlike(_HEAD)
    lines = lines.withColumn("old_header", F.coalesce(old, F.lit(False))).withColumn("new_header", F.coalesce(new, F.lit(False)))

    def named(mark: str, header: str) -> Column:
        """Path of the last file header before a line, without its first folder; empty for no file."""
        path = F.regexp_replace(F.substring_index(F.substring("line", 5, 1 << 20), "\t", 1), r"^[^/]*/", "")
        return F.last(F.when(F.col(header) & F.col("line").startswith(f"{mark}/dev/null"), F.lit("")).when(F.col(header), path), ignorenulls=True).over(w)

    lines = lines.withColumn("old_path", named("--- ", "old_header")).withColumn("new_path", named("+++ ", "new_header"))
    follows = F.lag(F.col("body") | F.col("new_header") | F.col("line").startswith("\\")).over(w)
    lines = lines.withColumn("loose", F.col("head") & ~F.coalesce(follows, F.lit(False)))
    ended = ~F.coalesce(F.col("next").startswith("\\"), F.lit(False))
    text = F.concat(F.substring("line", 2, 1 << 30), F.when(ended, F.lit("\n")).otherwise(F.lit("")))
    return lines.filter("hunk > 0").select(key, "hunk", "pos", "head", "loose", "body", "kind", "old_at", "old_path", "new_path", "old_start", "old_n", "new_start", "new_n", F.when(F.col("body"), text).alias("text"))


def _hunks(lines: DataFrame, key: str) -> DataFrame:
    """One row a hunk; ``sound`` tells whether its body is what its header says."""
    one = lambda c: F.first(F.when(F.col("head"), F.col(c)), ignorenulls=True).alias(c)
    kinds = lambda *k: F.coalesce(F.sum(F.when(F.col("body") & F.col("kind").isin(*k), 1)), F.lit(0))
    changed = F.col("body") & F.col("kind").isin("+", "-")
    found = lines.groupBy(key, "hunk").agg(
        *(one(c) for c in ("old_path", "new_path", "old_start", "old_n", "new_start", "new_n")), kinds(" ", "-").alias("n_old"), kinds(" ", "+").alias("n_new"),
        kinds(" ", "-", "+", "\\").alias("n_known"), F.count_if("body").alias("n_body"), F.bool_or("loose").alias("loose"), F.max(F.when(changed, F.col("pos"))).alias("last_change"),
        F.max(F.when(F.col("body") & (F.col("kind") == " "), F.col("pos"))).alias("last_context"),
    )
    sound = (F.col("n_old") == F.col("old_n")) & (F.col("n_new") == F.col("new_n")) & (F.col("n_known") == F.col("n_body")) & F.col("last_change").isNotNull()
    sound &= ~F.col("loose") & F.coalesce((F.col("old_path") != "") | (F.col("new_path") != ""), F.lit(False)) & F.col("old_path").isNotNull() & F.col("new_path").isNotNull()
    path = F.when(F.col("old_path") != "", F.col("old_path")).otherwise(F.col("new_path"))
    return found.select(
        key, "hunk", "old_path", "new_path", path.alias("path"), "old_start", "old_n", "new_start", "new_n", sound.alias("sound"),
        (F.col("old_start") <= 1).alias("at_top"), F.coalesce(F.col("last_context") < F.col("last_change"), F.lit(True)).alias("at_end"),
    )


def _places(hunks: DataFrame, old: DataFrame, lines: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, hunk, places): every line number, from 0, at which all old lines of a hunk stand in its file."""
    sized = hunks.join(sizes, "path").select(key, "hunk", "path", "old_n", "at_top", "at_end", "n_lines")
    often = lines.groupBy("path", "text").agg(F.count("*").alias("times"))
    wanted = old.join(sized, [key, "hunk"]).select(key, "hunk", "path", "old_at", "text", "old_n", "at_top", "at_end", "n_lines")
    rarest = wanted.join(often, ["path", "text"], "left").groupBy(key, "hunk").agg(
        F.min_by(F.struct("path", "old_at", "text", "old_n", "at_top", "at_end", "n_lines"), F.struct(F.coalesce("times", F.lit(0)), "old_at")).alias("r"), F.count_if(F.col("times").isNull()).alias("unknown")
    )
    known = rarest.filter("unknown = 0").select(key, "hunk", "r.*")
    at = known.join(lines, ["path", "text"]).withColumn("place", F.col("line") - F.col("old_at"))
    at = at.filter("place >= 0 and place + old_n <= n_lines and (not at_top or place = 0) and (not at_end or place + old_n = n_lines)").select(key, "hunk", "path", "place", "old_n")
    each = at.join(old, [key, "hunk"]).select(key, "hunk", "path", "place", "old_n", (F.col("place") + F.col("old_at")).alias("line"), "text")
    whole = each.join(lines, ["path", "line", "text"], "left_semi").groupBy(key, "hunk", "place", "old_n").agg(F.count("*").alias("same")).filter("same = old_n")
    # A hunk without old lines adds to the end of a file, or to an empty one.
    bare = sized.filter("old_n = 0 and (not at_top or n_lines = 0)").select(key, "hunk", F.col("n_lines").cast("long").alias("place"))
    return whole.select(key, "hunk", "place").unionByName(bare).groupBy(key, "hunk").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _take_in_order(hunks: Column) -> Column:
    """Fold over the hunks of one file: (hunk, at, offset) of each, ``at`` null where it finds no free place."""

    def shift(taken: Column, place: Column) -> Column:
        earlier = F.filter(taken, lambda t: (t["at"] < place) | ((t["at"] == place) & (t["old_n"] == 0)))
        return F.aggregate(earlier, F.lit(0).cast("long"), lambda a, t: a + t["new_n"] - t["old_n"])

    def step(state: Column, h: Column) -> Column:
        taken = state["taken"]
        free = F.filter(h["places"], lambda c: ~F.exists(taken, lambda t: (c < t["at"] + t["old_n"]) & (t["at"] < c + h["old_n"])))
        # The beginning and the end of a file are those of what earlier hunks have left.
        free = F.filter(free, lambda c: ~h["at_top"] | (shift(taken, c) + c == 0))
        free = F.filter(free, lambda c: ~h["at_end"] | ~F.exists(taken, lambda t: (t["at"] >= c + h["old_n"]) & (t["new_n"] > 0) & ((t["at"] > c) | (t["old_n"] > 0))))
        stated = F.greatest(h["new_start"] - 1, F.lit(0))
        near = F.array_min(F.transform(free, lambda c: F.struct(F.abs(c + shift(taken, c) - stated).alias("far"), (c + shift(taken, c) < stated).alias("back"), c.alias("at"), (c + shift(taken, c) - stated).alias("offset"))))
        took = F.when(near.isNull(), taken).otherwise(F.array_append(taken, F.struct(near["at"].alias("at"), h["old_n"].alias("old_n"), h["new_n"].alias("new_n"))))
        told = F.struct(h["hunk"].alias("hunk"), near["at"].alias("at"), near["offset"].alias("offset"), (F.size(h["places"]) > 0).alias("somewhere"))
        return F.struct(took.alias("taken"), F.array_append(state["told"], told).alias("told"))

    start = F.struct(F.array().cast("array<struct<at: bigint, old_n: bigint, new_n: bigint>>").alias("taken"), F.array().cast("array<struct<hunk: bigint, at: bigint, offset: bigint, somewhere: boolean>>").alias("told"))
    return F.aggregate(hunks, start, step)["told"]


def check_hunks(patches: DataFrame, files: DataFrame, key: str = "patch_id", patch: str = "patch") -> DataFrame:
    """(key, hunk, path, status, line, offset) of every hunk of every patch against ``files`` (path, content).

    exact: at the stated line; shifted: at the nearest other one (forward on
    ties), ``offset`` lines away; conflict: nowhere; overlap: only where an
    earlier hunk has changed lines; missing_file; exists: the file to be made
    is there; leaves_content: a removal that does not remove all; malformed:
    counts, marks or file headers are wrong. ``line`` counts from 1 in the
    unpatched file. A hunk whose old text starts at line 1 must lie at the
    beginning, and one without context after its last change at the end.
    Sections of one file in one patch are read as one. Paths lose their first
    folder; ``files`` has each path once.
    """
    lines = cut(hunk_lines(patches, key, patch), "patch")
    hunks = cut(_hunks(lines, key), "hunks")
    sound = hunks.filter("sound")
    old = lines.filter("body and kind in (' ', '-')").select(key, "hunk", F.col("old_at").cast("long"), "text")
    needed = files.join(sound.select("path").distinct(), "path", "left_semi").select("path", text_lines(F.coalesce("content", F.lit(""))).alias("lines"))
    in_files = cut(needed.select("path", F.size("lines").alias("n_lines"), F.posexplode_outer("lines").alias("line", "text")), "lines")
    sizes = in_files.groupBy("path").agg(F.first("n_lines").alias("n_lines"))
    file_lines = in_files.filter("text is not null").select("path", F.col("line").cast("long").alias("line"), "text")
    old_files = sound.filter("old_path <> ''")
    places = _places(old_files, old.join(old_files.select(key, "hunk"), [key, "hunk"], "left_semi"), file_lines, sizes, key)
    ready = old_files.join(sizes, "path").join(places, [key, "hunk"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))
    row = F.struct(F.col("hunk").cast("long").alias("hunk"), "new_start", "old_n", "new_n", "at_top", "at_end", "places")
    told = ready.groupBy(key, "path", "n_lines").agg(F.array_sort(F.collect_list(row)).alias("h")).select(key, "n_lines", F.inline(_take_in_order(F.col("h"))))
    whole = old_files.groupBy(key, "path").agg(F.sum("old_n").alias("all_old"), F.sum("new_n").alias("all_new"))
    joined = hunks.withColumn("hunk", F.col("hunk").cast("long")).join(told, [key, "hunk"], "left").join(whole, [key, "path"], "left").join(sizes.select("path", F.lit(True).alias("there")), "path", "left")
    makes = F.col("old_path") == ""
    status = (
        F.when(~F.col("sound"), "malformed").when(makes & F.col("there").isNotNull(), "exists").when(makes & (F.col("old_n") > 0), "malformed").when(makes, "exact")
        .when(F.col("there").isNull(), "missing_file").when(F.col("at").isNull() & F.col("somewhere"), "overlap").when(F.col("at").isNull(), "conflict")
        .when((F.col("new_path") == "") & ((F.col("all_old") != F.col("n_lines")) | (F.col("all_new") > 0)), "leaves_content").when(F.col("offset") == 0, "exact").otherwise("shifted")
    )
    return joined.select(key, "hunk", "path", status.alias("status"), (F.col("at") + 1).alias("line"), F.col("offset"))


def check_patches(patches: DataFrame, files: DataFrame, key: str = "patch_id", patch: str = "patch") -> DataFrame:
    """(key, applies, reason, n_hunks, n_shifted): one row a patch.

    ``reason`` is the status of the first hunk that does not apply, null if
    all do; ``empty`` for a patch without text, ``malformed`` for one without hunks.
    """
    hunks = check_hunks(patches, files, key, patch)
    bad = ~F.col("status").isin(*GOOD)
    told = hunks.groupBy(key).agg(F.count("*").alias("n_hunks"), F.count_if(F.col("status") == "shifted").alias("n_shifted"), F.min(F.when(bad, F.struct("hunk", "status")))["status"].alias("why"))
    empty = F.trim(F.regexp_replace(F.coalesce(F.col(patch), F.lit("")), r"\s", "")) == ""
    joined = patches.select(key, empty.alias("empty")).join(told, key, "left")
    reason = F.when(F.col("empty"), "empty").when(F.col("n_hunks").isNull(), "malformed").otherwise(F.col("why"))
    return joined.select(key, reason.isNull().alias("applies"), reason.alias("reason"), F.coalesce("n_hunks", F.lit(0)).alias("n_hunks"), F.coalesce("n_shifted", F.lit(0)).alias("n_shifted"))
