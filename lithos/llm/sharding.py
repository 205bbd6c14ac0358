"""Fixed virtual slots: records hash into thousands of slots, slots map to shards.

Bytes are summed per slot; a versioned slot-to-shard map is edited, slot by
slot, until shard sizes are near equal. Records never move between slots, so a
rebalance or a new shard changes only the map.

A slot of many bytes in several rows, as repeated rows make one, is split: the map gives it further slots at its end, and a second hash, of
a row's number, deals its rows out over them. A split stays in all later versions.

Edge cases: a null text has no bytes (size is the overhead alone); a null id
hashes as null together with the text's checksum; repeated rows share a slot until it is split
and get places of their own; a very long text is one row of one slot, so its shard is as large at least; an empty table gives no
rows and a map whose slots are dealt in turn; other columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.session import cut

N_SLOTS = 16384
OVERHEAD = 16
#: A slot of several rows is split if it has more than this part of a shard's mean bytes, into slots of about that much.
SPLIT = 16
MAP_SCHEMA = "version int, n_shards int, slot int, shard int, part_of int, bytes long, n_rows long"


@dataclass(frozen=True)
class SlotMap:
    """shards[i] is the shard of virtual slot i. Its size is the number of slots, whatever the data's.

    Slots from ``n_slots`` on belong to split ones: parts has (slot, first further slot, slots in all).
    """

    version: int
    n_shards: int
    shards: tuple[int, ...]
    parts: tuple[tuple[int, int, int], ...] = ()

    def split(self, totals: dict[int, tuple[int, int]], n_shards: int) -> SlotMap:
        """With further slots for those that are too heavy; at most ``SPLIT`` times the shards are, and are given twice as many."""
        share = max(1, sum(b for b, _ in totals.values()) // (n_shards * SPLIT))
        known = {slot for slot, _, _ in self.parts}
        shards, parts = list(self.shards), list(self.parts)
        for slot, (size, rows) in sorted(totals.items()):
            if size > share and rows > 1 and slot not in known and slot < self.n_hashed:
                n = min(rows, -(-size // share) + 1)
                parts.append((slot, len(shards), n))
                shards += [(self.shards[slot] + i) % self.n_shards for i in range(1, n)]
        return SlotMap(self.version, self.n_shards, tuple(shards), tuple(parts))

    @property
    def n_hashed(self) -> int:
        """The slots that records hash into."""
        return len(self.shards) - sum(n - 1 for _, _, n in self.parts)

    @staticmethod
    def first(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return SlotMap(0, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest while that narrows the gap.

        With a larger ``n_shards`` the added shards start empty and are filled in the same way.
        Slots of removed shards are dealt out first.
        """
        n = n_shards or self.n_shards
        shards = list(self.shards)
        load = [0] * n
        held: list[dict[int, int]] = [{} for _ in range(n)]
        orphans = []
        for slot, shard in enumerate(shards):
            if shard >= n:
                orphans.append(slot)
            else:
                size = slot_bytes.get(slot, 0)
                load[shard] += size
                if size:
                    held[shard][slot] = size
        for slot in sorted(orphans, key=lambda s: -slot_bytes.get(s, 0)):
            to = min(range(n), key=load.__getitem__)
            shards[slot], size = to, slot_bytes.get(slot, 0)
            load[to] += size
            if size:
                held[to][slot] = size
        while n > 1:
            low = min(range(n), key=load.__getitem__)
            high = max(range(n), key=load.__getitem__)
            gap = load[high] - load[low]
            best = min(((abs(gap - 2 * size), slot) for slot, size in held[high].items() if size < gap), default=None)
            if best is None:
                break
            slot = best[1]
            size = held[high].pop(slot)
            held[low][slot] = size
            load[high] -= size
            load[low] += size
            shards[slot] = low
        return SlotMap(self.version + 1, n, tuple(shards), self.parts)


def records(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def dealt(recs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Records with the rows of split slots dealt out over these by a hash of ``row``."""
    if not slot_map.parts:
        return recs
    # as many rows as slots are split
    table = F.broadcast(recs.sparkSession.createDataFrame(list(slot_map.parts), "virtual_slot int, _first int, _n int"))
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.col("_n")).cast("int")
    slot = F.when(part > 0, F.col("_first") + part - 1).otherwise(F.col("virtual_slot"))
    return recs.join(table, "virtual_slot", "left").withColumn("virtual_slot", slot).select(recs.columns)


def slot_totals(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used slot; at most a row for each slot reaches the driver."""
    rows = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def map_frame(spark: SparkSession, slot_map: SlotMap, totals: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a table, to be stored by version."""
    of = {first + i: slot for slot, first, n in slot_map.parts for i in range(n - 1)}
    rows = [(slot_map.version, slot_map.n_shards, i, s, of.get(i), *totals.get(i, (0, 0))) for i, s in enumerate(slot_map.shards)]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(spark: SparkSession, slot_map: SlotMap, totals: dict[int, tuple[int, int]], path: str) -> None:
    """Write one version under ``path``; earlier versions stay."""
    map_frame(spark, slot_map, totals).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the newest."""
    df = spark.read.parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = sorted(df.filter(F.col("version") == version).select("slot", "shard", "n_shards", "part_of").collect())
    further: dict[int, list[int]] = {}
    for r in rows:
        if r["part_of"] is not None:
            further.setdefault(r["part_of"], []).append(r["slot"])
    parts = tuple((slot, own[0], len(own) + 1) for slot, own in sorted(further.items(), key=lambda kv: kv[1]))
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows), parts)


def apply_map(recs: DataFrame, slot_map: SlotMap, totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Each record of ``dealt`` with its shard and its place there, gapless from 0.

    Places are numbered within a virtual slot and shifted by the rows of the
    shard's earlier slots, so no task holds more than a slot at once.
    """
    nxt = [0] * slot_map.n_shards
    rows = []
    for i, shard in enumerate(slot_map.shards):
        rows.append((i, shard, nxt[shard]))
        nxt[shard] += totals.get(i, (0, 0))[1]
    table = recs.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, before long")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "row")
    placed = recs.withColumn("_place", F.row_number().over(w).cast("long") - 1)
    # one row per virtual slot: its size is fixed by n_slots
    return placed.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("before") + F.col("_place")).drop("before", "_place", "row")


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """Rows of ``docs`` by the law of near-equal bytes.

    Returns doc_id, size, text_crc32, virtual_slot, shard, slot (place in the shard), map_version.
    ``slot_map`` is a stored map to edit; ``store`` a folder for the new version, and for the one before it if there was none.
    """
    # a row's number stays with it in the checkpoint
    recs = cut(records(docs, n_slots).withColumn("row", F.monotonically_increasing_id()))
    before = slot_map
    if before is None:
        before = SlotMap.first(n_shards, n_slots)
        if store:
            store_map(docs.sparkSession, before, {}, store)
    recs = dealt(recs, before)
    totals = slot_totals(recs)
    wider = before.split(totals, n_shards)
    if wider != before:
        recs = dealt(recs, SlotMap(wider.version, wider.n_shards, wider.shards, wider.parts[len(before.parts) :]))
        totals = slot_totals(recs)
    new = wider.rebalanced({k: v[0] for k, v in totals.items()}, n_shards)
    if store:
        store_map(docs.sparkSession, new, totals, store)
    return apply_map(recs, new, totals).withColumn("map_version", F.lit(new.version))
