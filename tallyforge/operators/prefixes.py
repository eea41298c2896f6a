"""Byte prefixes of files through a ladder of digests.

A file's ladder holds a digest of every prefix that ends at a chunk border, each made of the one before and the chunk's own. Whether a file
begins with another is then an equi join on the last border of the shorter and a comparison of the bytes behind it; how far two
files agree is the highest rung they share, and a search in one chunk. Only digests and single chunks are shuffled, never whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16


def _piece(k: Column, chunk: int) -> Column:
    return F.substring("content", (k * chunk + 1).cast("int"), F.lit(chunk))


def _last_line(piece: Column) -> Column:
    """How many bytes of a piece its last line feed ends; 0 without one. Each byte is one character of the text."""
    text = F.decode(piece, "ISO-8859-1")
    return F.length(text) - F.length(F.substring_index(text, "\n", -1))


def ladder(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, k, digest, line_end): of files(key, content), for each whole chunk border from 0 on, a digest of the k chunks before it and where
    the last whole line before it ends. A null content has no rung."""
    whole = F.floor(F.octet_length("content") / chunk).cast("int")
    chunks = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(F.sha2(_piece(i, chunk), 256).alias("own"), (_last_line(_piece(i, chunk))).alias("line"), i.alias("i")))).otherwise(F.array())
    start = F.array(F.struct(F.lit("").alias("digest"), F.lit(0).cast("long").alias("line_end")))

    def up(rungs: Column, c: Column) -> Column:
        last = F.element_at(rungs, -1)
        end = F.when(c["line"] > 0, c["i"].cast("long") * chunk + c["line"]).otherwise(last["line_end"])
        return F.array_append(rungs, F.struct(F.sha2(F.concat(last["digest"], c["own"]).cast("binary"), 256).alias("digest"), end.alias("line_end")))

    return files.where("content is not null").select("key", F.posexplode(F.aggregate(chunks, start, up)).alias("k", "rung")).select("key", "k", "rung.digest", "rung.line_end")


def pieces(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, k, piece): the chunks of files(key, content); behind a last border the piece is empty."""
    whole = F.floor(F.octet_length("content") / chunk).cast("int")
    return files.where("content is not null").select("key", F.explode(F.sequence(F.lit(0), whole)).alias("k"), "content").select("key", "k", _piece(F.col("k"), chunk).alias("piece"))


def _tips(files: DataFrame, chunk: int) -> DataFrame:
    """(key, size, k, digest, tail): each file's last border and the bytes behind it."""
    whole = F.floor(F.octet_length("content") / chunk).cast("int")
    tip = files.where("content is not null").select("key", F.octet_length("content").cast("long").alias("size"), whole.alias("k"), _piece(whole, chunk).alias("tail"))
    return tip.join(ladder(files, chunk).drop("line_end"), ["key", "k"])


def begins(files: DataFrame, longer: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key) of files(key, content) that the file of the same key in longer(key, content) begins with."""
    # digests first; the bytes of one chunk for those only that agree up to the border
    met = _tips(files, chunk).join(ladder(longer, chunk).drop("line_end"), ["key", "k", "digest"]).select("key", "k", "tail")
    behind = pieces(longer, chunk).join(met, ["key", "k"])
    return behind.where(F.substring("piece", F.lit(1), F.octet_length("tail")) == F.col("tail")).select("key")


def _holds(files: DataFrame, seats: DataFrame, chunk: int) -> DataFrame:
    """(key, kind, word) of seats(key, kind, content) under the keys of files: identical, prefix-extended, differs or other."""
    sizes = files.select("key", F.octet_length("content").cast("long").alias("size"))
    there = seats.join(sizes, "key").select("key", "kind", "size", F.octet_length("content").cast("long").alias("held"))
    same = begins(files, seats.where("kind = 'file'").select("key", "content"), chunk).distinct().withColumn("begins", F.lit(True))
    x = there.join(same, "key", "left")
    word = F.when(F.col("kind") != "file", "other").when((F.col("held") >= F.col("size")) & F.col("begins"), F.when(F.col("held") == F.col("size"), "identical").otherwise("prefix-extended")).otherwise("differs")
    return x.select("key", "kind", word.alias("word"))


def proof(files: DataFrame, seats: DataFrame, beside: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, status): how the destination holds each of files(key, content), keys distinct on each side.

    seats(key, kind 'file', 'link' or 'other', content) stand at the destination's key, beside (the same columns) at that key with the suffix.
    identical; prefix-extended: it holds these bytes and more; identical-beside, prefix-extended-beside: the seat beside does, the one at the key not;
    differs; absent; dest-link; dest-other. An empty file is a prefix of any.
    """
    main = _holds(files, seats, chunk)
    x = files.select("key").join(main, "key", "left")
    x = x.join(_holds(files, beside, chunk).select("key", F.col("word").alias("by")), "key", "left") if beside is not None else x.withColumn("by", F.lit(None).cast("string"))
    status = (
        F.when(F.col("word").isin("identical", "prefix-extended"), F.col("word"))
        .when(F.col("by").isin("identical", "prefix-extended"), F.concat("by", F.lit("-beside")))
        .when(F.col("word").isNull(), "absent")
        .when(F.col("word") == "other", F.when(F.col("kind") == "link", "dest-link").otherwise("dest-other"))
        .otherwise(F.col("word"))
    )
    return x.select("key", status.alias("status"))


def common(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, bytes, line_bytes) for keys of both a and b(key, content): how many first bytes agree, and how many of these whole lines end in."""
    shared = ladder(a, chunk).join(ladder(b, chunk).select("key", "k", "digest"), ["key", "k", "digest"]).groupBy("key").agg(F.max_by(F.struct("k", "line_end"), "k").alias("top")).select("key", "top.*")
    x = shared.join(pieces(a, chunk).withColumnRenamed("piece", "pa"), ["key", "k"]).join(pieces(b, chunk).withColumnRenamed("piece", "pb"), ["key", "k"])
    most = F.least(F.octet_length("pa"), F.octet_length("pb"))
    bits = max(chunk, 1).bit_length()

    def further(n: Column, step: Column) -> Column:
        # a step further where the bytes agree up to there
        to = n + step
        return F.when((to <= most) & (F.substring("pa", F.lit(1), to) == F.substring("pb", F.lit(1), to)), to).otherwise(n)

    n = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(bits))]), F.lit(0), further)
    x = x.withColumn("n", n).withColumn("line", _last_line(F.substring("pa", F.lit(1), F.col("n"))))
    at = F.col("k").cast("long") * chunk
    return x.select("key", (at + F.col("n")).alias("bytes"), F.when(F.col("line") > 0, at + F.col("line")).otherwise(F.col("line_end")).alias("line_bytes"))


def extensions(source: DataFrame, held: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, state, tail) for each of source(key, content): absent, same, extend (held is a proven prefix, tail are the bytes to append) or not-prefix."""
    lengths = held.select("key", F.octet_length("content").cast("long").alias("held"))
    proven = begins(held.join(source.select("key"), "key", "left_semi"), source, chunk).withColumn("begins", F.lit(True))
    x = source.join(lengths, "key", "left").join(proven, "key", "left")
    size = F.octet_length("content").cast("long")
    state = F.when(F.col("held").isNull(), "absent").when(F.coalesce("begins", F.lit(False)), F.when(F.col("held") == size, "same").otherwise("extend")).otherwise("not-prefix")
    return x.select("key", state.alias("state"), F.when(state == "extend", F.substring("content", (F.col("held") + 1).cast("int"), (size - F.col("held")).cast("int"))).alias("tail"))


def fold_plan(copies: DataFrame, mapped: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, action) for each of copies(key, content, append_log), files under a source's key, against mapped(key, content) at the key that it maps to:
    fold-move where nothing is there, fold-union of append logs, fold-remove of equal bytes, fold-hold of others."""
    same = proof(copies.select("key", "content"), mapped.select("key", F.lit("file").alias("kind"), "content"), chunk=chunk)
    x = copies.select("key", "append_log").join(same, "key")
    action = F.when(F.col("status") == "absent", "fold-move").when(F.col("append_log"), "fold-union").when(F.col("status") == "identical", "fold-remove").otherwise("fold-hold")
    return x.select("key", action.alias("action"))
