"""Merkle fixity audit of replicated web archives.

Records are ordered by id. Files hold FILE consecutive ids, and a record's place in its file is
the range of offsets [offset, offset + length). A leaf is the hash of an id's records; a node is
the hash of its children of FAN consecutive ids, in order, each with the range of offsets that it
takes, counted from the node's start, up to one root for each file. Counted so, a lost record is
one fault on one path, though all records after it move up.
Two replicas are compared by their roots; only children of nodes that differ are looked at, level
by level, down to the ids whose records differ.

Records that share an id are summed up, order-free, before they move, so that a frequent id is
one leaf and no hot key. A file has at most FILE leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import discard, materialize

FAN_BITS = 4
FAN = 1 << FAN_BITS
LEVELS = 3
FILE = FAN**LEVELS


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.0 resource record, as a string."""
    body = F.coalesce(payload, F.lit(""))
    size = F.octet_length(body).cast("string")
    text = lambda s: F.lit(s)
    return F.concat(
        text("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:id:"), F.coalesce(record_id.cast("string"), F.lit("")),
        text(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), text("\r\nContent-Type: text/html\r\nContent-Length: "), size, text("\r\n\r\n"), body, text("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """file, id, offset, length, n_records, hash: one row per id of records (columns id, record).

    A null id is a leaf of its own, in file null.
    """
    digest = F.sha2("record", 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    # Sums of the digests' four words: equal for equal sets of records, whatever their order.
    summed = records.select("id", F.octet_length("record").cast("long").alias("length"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    summed = summed.groupBy("id").agg(F.sum("length").alias("length"), F.count("*").alias("n_records"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)])
    summed = summed.withColumn("file", _up("id", LEVELS))
    upto = F.sum("length").over(_window())
    summed = summed.withColumn("offset", (upto - F.col("length")).cast("long"))
    values = ["id", "length", "n_records", *[f"p{i}" for i in range(4)]]
    joined = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]), 256)
    return summed.select("file", "id", "offset", "length", "n_records", joined.alias("hash"))


def _window() -> WindowSpec:
    return Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _up(node: str, levels: int) -> Column:
    """The node so many levels above: whole division by FAN ** levels, exact for every long."""
    return F.shiftright(node, FAN_BITS * levels)


def nodes(leaf: DataFrame, level: int) -> DataFrame:
    """file, node, length, hash: the nodes that span FAN ** level ids each."""
    if not level:
        return leaf.select("file", F.col("id").alias("node"), "length", "hash")
    below = nodes(leaf, level - 1)
    children = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))
    up = below.groupBy("file", _up("node", 1).alias("up")).agg(children.alias("children"), F.sum("length").alias("length"))
    # The offset of a child is the length of those before it: FAN of them at most.
    before = lambda i: F.aggregate(F.slice("children", F.lit(1), i), F.lit(0).cast("long"), lambda a, c: a + c["length"])
    line = lambda c, i: F.concat_ws(":", F.coalesce(c["node"].cast("string"), F.lit("")), before(i).cast("string"), c["length"].cast("string"), c["hash"])
    joined = F.array_join(F.transform("children", line), "|")
    return up.select("file", F.col("up").alias("node"), "length", F.sha2(joined, 256).alias("hash"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, id, offset, length, kind of each id whose records differ between the replicas (both
    with columns id long, record string).

    kind is 'missing' (only in primary), 'extra' (only in replica) or 'changed'. offset and length are the primary's (the
    replica's for extra). Null records count as empty ones; repeated rows count with their
    number; equal replicas, or empty ones, give an empty result; other columns are ignored.
    """
    a, b = (materialize(_own(x), name) for x, name in ((primary, "primary-leaves"), (replica, "replica-leaves")))
    suspects = None
    for level in range(LEVELS, -1, -1):
        x, y = (_within(leaf, suspects, level + 1) if suspects is not None else leaf for leaf in (a, b))
        x, y = nodes(x, level).drop("length"), nodes(y, level).drop("length")
        both = x.withColumnRenamed("hash", "x").join(y.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("hash").alias("y")), F.col("file").eqNullSafe(F.col("f")) & F.col("node").eqNullSafe(F.col("n")), "full_outer")
        differ = both.where(~F.col("x").eqNullSafe(F.col("y")))
        lower = materialize(differ.select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node")), f"level-{level}")
        if suspects is not None:
            discard(suspects)
        suspects = lower
    x, y = _within(a, suspects, 0), _within(b, suspects, 0)
    y = y.select(*[F.col(c).alias(f"r_{c}") for c in y.columns])
    out = x.join(y, F.col("id").eqNullSafe(F.col("r_id")) & F.col("file").eqNullSafe(F.col("r_file")), "full_outer")
    kind = F.when(F.col("r_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return out.select(*[F.coalesce(c, f"r_{c}").alias(c) for c in ("file", "id", "offset", "length")], kind.alias("kind"))


def _own(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("id").cast("long").alias("id"), F.coalesce("record", F.lit("")).alias("record"))
    return leaves(rows)


def _within(leaf: DataFrame, suspects: DataFrame, level: int) -> DataFrame:
    """The leaves below the suspect nodes of that level."""
    node = _up("id", level)
    s = suspects.select(F.col("file").alias("s_file"), F.col("node").alias("s_node"))
    return leaf.join(s, F.col("file").eqNullSafe(F.col("s_file")) & node.eqNullSafe(F.col("s_node")), "left_semi")
