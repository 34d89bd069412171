"""Line deduplication by winnowing, in DataFrame functions only.

Lines that are not blank are hashed. A window is a shortest run of lines with `min_chars` characters: from each line on,
and back from each line. The smallest line hash of a window is its fingerprint, so any repeated run with `min_chars`
characters shares one, wherever the run begins. Fingerprints that stand at one place only fall out. The windows that
reach both ways from the others are joined with the first place of the same run of lines: what has an earlier copy goes.

The windows inside a run cover all of it (from its start forward, from its end back), so extending a match line by line
is a union of windows, and no run depends on the text in which one of its fingerprints happens to stand first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from warden.llm import common

MIN_CHARS = 40


def _windows(min_chars: int) -> Column:
    """(first, n) of the shortest runs with enough characters, from the array `sizes` of one text's lines."""
    # Lines hold a character at least, so a run of min_chars lines is always long enough.
    step = f"""named_struct('sum', 0, 'n', 0),
        (s, x) -> if(s.sum >= {min_chars}, s, named_struct('sum', s.sum + x, 'n', s.n + 1))"""
    on = f"aggregate(slice(sizes, i + 1, {min_chars}), {step})"
    back = f"aggregate(reverse(slice(sizes, greatest(i + 2 - {min_chars}, 1), least(i + 1, {min_chars}))), {step})"
    # A run that is shortest in both directions is taken once, from its first line.
    return F.expr(f"""flatten(transform(sizes, (size, i) -> if(size >= {min_chars},
        array(named_struct('first', i, 'n', 1)),
        filter(concat(
            transform(array({on}), s -> if(s.sum >= {min_chars}, named_struct('first', i, 'n', s.n), null)),
            transform(array({back}), s -> if(s.sum - size >= {min_chars},
                named_struct('first', i + 1 - s.n, 'n', s.n), null))), w -> w is not null))))""")


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, n, run, mark, gram, at): each window's first line and length, two hashes of its lines, its fingerprint
    and the line that holds it. Lines are numbered without the blank ones; place is (doc_id, version, line)."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda line: F.trim(line)), lambda line: line != "")
    hashed = (docs.where(F.col(text).isNotNull())
              .select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), lines.alias("lines"))
              .select("doc_id", "version", F.transform("lines", lambda line: F.xxhash64(line)).alias("cells"),
                      F.transform("lines", lambda line: F.hash(line)).alias("marks"),
                      F.transform("lines", lambda line: F.length(line)).alias("sizes")))
    found = F.expr("""transform(windows, w -> named_struct('first', w.first, 'n', w.n,
        'run', xxhash64(slice(cells, w.first + 1, w.n)), 'mark', hash(slice(marks, w.first + 1, w.n)),
        'gram', array_min(slice(cells, w.first + 1, w.n))))""")
    at = F.expr("""transform(found, w -> named_struct('w', w,
        'at', w.first + cast(array_position(slice(cells, w.first + 1, w.n), w.gram) as int) - 1))""")
    spread = (hashed.withColumn("windows", _windows(min_chars)).withColumn("found", found)
              .select("doc_id", "version", F.explode(at).alias("p")))
    return spread.select(F.struct("doc_id", "version", F.col("p.w.first").alias("line")).alias("place"),
                         F.col("p.w.n").alias("n"), F.col("p.w.run").alias("run"), F.col("p.w.mark").alias("mark"),
                         F.col("p.w.gram").alias("gram"), F.col("p.at").alias("at"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, gone): the numbers, not counting blank lines, of the lines to remove from each text.

    `version` is the text's hash: two texts under one id stay apart.
    """
    found = common.saved(windows(docs, doc_id, text, min_chars), "windows")
    holder = F.struct("place.doc_id", "place.version", "at")
    grams = found.groupBy("gram").agg(F.min(holder).alias("low"), F.max(holder).alias("high")).where(
        ~F.col("low").eqNullSafe(F.col("high"))).select("gram")
    matched = found.join(grams, "gram", "left_semi").select("place", "n", "run", "mark")
    first = (matched.groupBy("run", "mark", "n").agg(F.min("place").alias("first"), F.max("place").alias("last"))
             .where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = matched.join(first, ["run", "mark", "n"]).where(~F.col("place").eqNullSafe(F.col("first")))
    spans = later.select("place.doc_id", "place.version",
                         F.sequence(F.col("place.line"), F.col("place.line") + F.col("n") - 1).alias("gone"))
    return spans.groupBy("doc_id", "version").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with later repeats of runs of lines taken out of `text`, and n_lines_removed (clashing names: see below).

    A line goes exactly if it lies in a run of lines with `min_chars` characters that also stands at an earlier place.
    Order is (doc_id, hash of the text, line), so the first place of a run never goes. Lines are compared without blanks
    around them; blank lines are not compared, and go if the nearest lines above and below both go. Short repeated lines
    stay unless they stand in such a run. Equal runs are equal in 96 bits of hashes and in their number of lines.
    Null texts stay null; an empty text stays empty; a text of which all lines go becomes empty; no row is dropped.
    Repeated rows (same id and text) count as one place and all stay. Rows with a null id come first in the order.
    An input column named n_lines_removed is replaced.
    """
    gone = repeated(docs, doc_id, text, min_chars).select(
        F.col("doc_id").alias("__gone_id"), F.col("version").alias("__gone_version"), F.col("gone").alias("__gone"))
    docs = docs.drop("n_lines_removed")
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__gone_id"))
                       & (F.xxhash64(F.col(text)) == F.col("__gone_version")), "left")
    split = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n", -1)))
    numbered = split.withColumn("__numbers", F.expr(
        "filter(transform(__lines, (line, i) -> if(trim(line) = '', null, i)), i -> i is not null)"))
    out = numbered.withColumn("__out", F.expr("""flatten(transform(__gone, (g, i) -> if(get(__gone, i + 1) = g + 1,
        sequence(get(__numbers, g), get(__numbers, g + 1) - 1), array(get(__numbers, g)))))"""))
    kept = F.expr("""array_join(transform(array_except(sequence(0, size(__lines) - 1), __out),
        i -> get(__lines, i)), '\n')""")
    return out.select(
        *[F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`")
          for c in docs.columns], F.coalesce(F.size("__out"), F.lit(0)).alias("n_lines_removed"))
