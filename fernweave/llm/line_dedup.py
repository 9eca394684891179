"""Line dedup: repeated passages of lines, removed where they stand again in the corpus.

A passage is a run of two lines or more with over 50 words.  Around each line lie two least passages, the shortest that
begins with it and the shortest that ends with it, whose extent depends on their own lines alone.  Whatever run is repeated,
each of its lines lies in a least passage within the run, so finding the least passages that occur again finds all of it.

Content-defined chunks are compared besides, however few words they have.  A rolling hash over the hashes of each two
neighbouring lines chooses where a chunk ends: where it is less than at the lines before and after.  Chunks so have two lines
at least and about three on average.

Of each passage or chunk that occurs again, the first occurrence (by doc_id, text hash and position) stays, and the lines of
those that equal it go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_skewed, let, words

#: A run of lines is a passage if it has more words.
PASSAGE_WORDS = 50
#: A span of lines as one number: the first line times this, plus the last.
_SPAN = 1 << 32


def _cuts(lines: Column) -> Column:
    """Array of (start, end): the first and last line of each chunk."""
    last = F.size(lines) - 1
    rolling = lambda h: F.transform(h, lambda x, i: F.xxhash64(h[F.greatest(i - 1, F.lit(0))], x))
    least = lambda r, i: (i > 0) & (i < last - 1) & (r[i] < r[F.greatest(i - 1, F.lit(0))]) & (r[i] <= r[F.least(i + 1, last)])
    ends = lambda r: F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | least(r, i))
    spans = lambda e: F.transform(e, lambda x, j: F.struct(F.when(j == 0, 0).otherwise(e[F.greatest(j - 1, F.lit(0))] + 1).alias("start"), x.alias("end")))
    return let(let(let(F.transform(lines, lambda x: F.xxhash64(x)), rolling), ends), spans)


def chunks(text: Column) -> Column:
    """Array of (n_lines, text), in order; the texts joined by line feeds are ``text``.  Only a text of one line has a chunk of one."""

    def cut(lines: Column) -> Column:
        return F.transform(_cuts(lines), lambda s: F.struct((s["end"] - s["start"] + 1).alias("n_lines"), F.array_join(F.slice(lines, s["start"] + 1, s["end"] - s["start"] + 1), "\n").alias("text")))

    return let(F.split(text, "\n", -1), cut)


def _passages(lines: Column) -> Column:
    """Spans of the shortest passages that begin with each line, then of those that end with each; null where there is none."""
    mark = F.lit(-1)  # stands before the words of each line, given as the line's number
    stream = F.flatten(F.transform(lines, lambda x, i: F.concat(F.array(mark), F.array_repeat(i, F.size(words(x))))))

    def spans(s: Column, at: Column, line: Column) -> Column:
        last, n_words = F.size(lines) - 1, F.size(line)
        before = lambda i: at[i] - i  # words in the lines before i
        begun = F.transform(at, lambda x, i: F.when((i < last) & (before(i) + PASSAGE_WORDS < n_words), i * F.lit(_SPAN) + F.greatest(i + 1, line[F.least(before(i) + PASSAGE_WORDS, n_words - 1)])))
        up_to = lambda i: F.when(i < last, before(F.least(i + 1, last))).otherwise(n_words)
        ended = F.transform(at, lambda x, i: F.when((i > 0) & (up_to(i) > PASSAGE_WORDS), F.least(i - 1, line[F.greatest(up_to(i) - PASSAGE_WORDS - 1, F.lit(0))]) * F.lit(_SPAN) + i))
        return F.concat(begun, ended)

    def found(s: Column) -> Column:
        places = F.filter(F.transform(s, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
        return let(places, lambda at: let(F.filter(s, lambda x: x != mark), lambda line: spans(s, at, line)))

    return F.when(F.size(lines) > 1, let(stream, found)).otherwise(F.array().cast("array<bigint>"))


def _hashed_spans(text: Column) -> Column:
    """Array of (start, end, hash) of the passages and of the chunks of two lines or more, each span once."""

    def spans(lines: Column) -> Column:
        cut = F.transform(F.filter(_cuts(lines), lambda s: s["end"] > s["start"]), lambda s: s["start"] * F.lit(_SPAN) + s["end"])
        every = F.array_distinct(F.filter(F.concat(cut, _passages(lines)), lambda x: x.isNotNull()))
        ends = F.transform(every, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.cast("bigint").bitwiseAND(F.lit(_SPAN - 1)).cast("int").alias("end")))
        hashes = F.transform(lines, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.transform(ends, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.slice(h, s["start"] + 1, s["end"] - s["start"] + 1)).alias("hash"))))

    return let(F.split(text, "\n", -1), spans)


def _digest(lines: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the bytes of a span of lines."""
    return F.unhex(F.sha2(F.array_join(F.slice(lines, start + 1, end - start + 1), "\n"), 256))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages and chunks of lines taken out of ``text``, and n_lines, n_removed (lines).

    Every line goes that lies in a run of two lines or more with over 50 words which also stands at an earlier place, or in a
    chunk which does; where the two overlap within one document, the lines of the earlier stay.  They are found by a 64-bit
    hash and told apart by their SHA-256.  Single repeated lines stay.  All rows stay; a text of which nothing is left becomes
    empty, a null text stays null and counts no lines.  Rows alike in doc_id and text are one document: they share their fate,
    and a passage that only they hold isn't repeated.  Null doc_ids sort first.  Columns of ``docs`` that bear the new names
    are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    keyed = docs.select(*keep, doc.alias("__doc"), F.xxhash64("text").alias("__text"))
    lines = F.split("text", "\n", -1)

    place = ("__doc", "__text", "start", "end")
    found = checkpointed(keyed.select("__doc", "__text", F.explode(_hashed_spans(F.col("text"))).alias("s")).select("s.hash", "__doc", "__text", "s.start", "s.end"))
    first = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")).where("n > 1")
    first = checkpointed(first.select("hash", "n", *(F.col(f"first.{c}").alias(f"first{c}") for c in place)))

    again = join_skewed(found, first, ["hash"], "n").where("not (__doc = first__doc and __text = first__text and start = firststart)")
    later = F.when((F.col("__doc") == F.col("first__doc")) & (F.col("__text") == F.col("first__text")), F.greatest(F.col("start"), F.col("firstend") + 1)).otherwise(F.col("start"))
    again = checkpointed(again.select("hash", *place, later.alias("from")).distinct())
    counts = again.groupBy("hash").agg(F.count("*").alias("n"))
    owned = checkpointed(first.drop("n").join(counts, "hash"))

    owners = owned.groupBy(F.col("first__doc").alias("__doc"), F.col("first__text").alias("__text")).agg(F.collect_list(F.struct("hash", "n", F.col("firststart").alias("start"), F.col("firstend").alias("end"))).alias("own"))
    held = keyed.select("__doc", "__text", "text").join(owners, ["__doc", "__text"]).dropDuplicates(["__doc", "__text"])
    held = held.select(let(lines, lambda x: F.transform("own", lambda o: F.struct(o["hash"].alias("hash"), o["n"].alias("n"), _digest(x, o["start"], o["end"]).alias("digest")))).alias("own"))
    digests = checkpointed(held.select(F.explode("own").alias("o")).select("o.*"))
    marks = join_skewed(again, digests, ["hash"], "n").groupBy("__doc", "__text").agg(F.collect_list(F.struct("start", "end", "from", "digest")).alias("marks"))

    def left(x: Column) -> Column:
        same = F.filter("marks", lambda m: (m["from"] <= m["end"]) & (_digest(x, m["start"], m["end"]) == m["digest"]))
        gone = F.flatten(F.transform(same, lambda m: F.sequence(m["from"], m["end"])))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i])

    joined = keyed.join(marks, ["__doc", "__text"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    rest = joined.withColumns({"n_lines": n_lines, "__kept": F.when(F.col("marks").isNotNull(), let(lines, left))})
    final = rest.withColumn("n_removed", F.when(F.col("__kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("__kept")))
    return final.withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))).select(*keep, "n_lines", "n_removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated multi-line chunks taken out of ``text``, and n_lines, n_removed (lines).

    Chunks only: a repeated passage keeps the lines that share a chunk with others; :func:`dedup_passages` takes those too.

    All rows stay; a text of which nothing is left becomes empty, a null text stays null and counts no lines.  Rows alike in
    doc_id and text are one document: they share their fate, and a chunk that only they hold isn't repeated.  A chunk found
    twice within one document goes at the second place.  Null doc_ids sort first.  Columns of ``docs`` that bear the new
    names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    keyed = docs.select(*keep, doc.alias("__doc"), F.xxhash64("text").alias("__text"))
    placed = keyed.select("__doc", "__text", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).where("chunk.n_lines > 1")
    found = checkpointed(placed.select("__doc", "__text", "pos", F.xxhash64("chunk.text").alias("hash"), F.octet_length("chunk.text").alias("bytes")).distinct())

    place = ("__doc", "__text", "pos")
    first = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first"), F.max("bytes").cast("bigint").alias("bytes")).where("n > 1")
    first = checkpointed(first)

    owners = first.select("hash", "n", "bytes", *(F.col(f"first.{c}").alias(c) for c in place)).groupBy("__doc", "__text").agg(F.collect_list(F.struct("pos", "hash", "n", "bytes")).alias("own"))
    held = keyed.select("__doc", "__text", "text").join(owners, ["__doc", "__text"]).dropDuplicates(["__doc", "__text"])
    held = held.select(let(chunks(F.col("text")), lambda c: F.transform("own", lambda o: F.struct(o["hash"].alias("hash"), o["n"].alias("n"), o["bytes"].alias("bytes"), c[o["pos"]]["text"].alias("first")))).alias("own"))
    texts = checkpointed(held.select(F.explode("own").alias("o")).select("o.*"))

    again = join_skewed(found.drop("bytes"), first.select("hash", "n", "bytes", *(F.col(f"first.{c}").alias(f"first{c}") for c in place)), ["hash"], "n", "bytes")
    again = again.where("not (__doc = first__doc and __text = first__text and pos = firstpos)").select("hash", *place)
    marks = join_skewed(again, texts, ["hash"], "n", "bytes").groupBy("__doc", "__text").agg(F.collect_list(F.struct("pos", "first")).alias("marks"))

    joined = keyed.join(marks, ["__doc", "__text"], "left")
    same = lambda c, i: F.exists("marks", lambda m: (m["pos"] == i) & (m["first"] == c["text"]))
    kept = let(chunks(F.col("text")), lambda all_: F.filter(all_, lambda c, i: ~same(c, i)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    rest = joined.withColumns({"n_lines": n_lines, "__kept": F.when(F.col("marks").isNotNull(), kept)})
    left = F.aggregate("__kept", F.lit(0), lambda a, c: a + c["n_lines"])
    final = rest.withColumns({"n_removed": F.when(F.col("__kept").isNull(), 0).otherwise(F.col("n_lines") - left), "__new": F.array_join(F.transform("__kept", lambda c: c["text"]), "\n")})
    return final.withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.col("__new"))).select(*keep, "n_lines", "n_removed")
