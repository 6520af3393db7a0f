"""Artifacts: versions, listings, content outcomes, derivation trees, bibliographic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegraph.functions.ranking import order_rows
from citegraph.session import Rounds

ROLE_PATTERN = "^[a-z0-9_-]+$"


def record_artifacts(arriving: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The artifact table after `arriving` (canonical_id, role, seq, …) has been recorded on top of `held`.

    Versions continue after the held maximum of each (node, role) in arrival order; only the
    newest is current. Numbering is range-split, so one work may hold any share of the rows.
    """
    numbered = order_rows(arriving, ["canonical_id", "role"], ["seq"], "version")
    if held is not None:
        reach = held.groupBy("canonical_id", "role").agg(F.max("version").alias("_held"))
        numbered = (
            numbered.join(reach, ["canonical_id", "role"], "left")
            .withColumn("version", F.col("version") + F.coalesce("_held", F.lit(0)))
            .drop("_held")
        )
    everything = numbered.drop("seq")
    if held is not None:
        everything = everything.unionByName(held.drop("is_current"), allowMissingColumns=True)
    newest = everything.groupBy("canonical_id", "role").agg(F.max("version").alias("_newest"))
    return (
        everything.join(newest, ["canonical_id", "role"])
        .withColumn("is_current", F.col("version") == F.col("_newest"))
        .withColumn("key", F.concat_ws("/", "canonical_id", "role", F.concat(F.lit("v"), F.col("version"))))
        .drop("_newest")
    )


def bad_roles(artifacts: DataFrame) -> DataFrame:
    return artifacts.where(~F.col("role").rlike(ROLE_PATTERN))


def list_artifacts(
    artifacts: DataFrame, requests: DataFrame | None = None, role: str | None = None, all_versions: bool = False
) -> DataFrame:
    """Descriptors of the requested nodes (all when none), role ascending, newest version first."""
    out = artifacts
    if requests is not None:
        out = out.join(requests.select("canonical_id").distinct(), "canonical_id", "left_semi")
    if role is not None:
        out = out.where(F.col("role") == role)
    if not all_versions:
        out = out.where("is_current")
    return out.orderBy("canonical_id", "role", F.desc("version"))


def sniff_mime(head: Column) -> Column:
    """Best-effort mime from the first bytes."""
    return F.when(F.startswith(head, F.lit(b"%PDF")), "application/pdf").otherwise("application/octet-stream")


def blob_listing(spark, path: str) -> DataFrame:
    """(path, length, head) of stored blobs; content is read only for its first bytes' test."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_replace("path", "^.*?([^/]+/[^/]+/v[0-9]+)$", "$1").alias("key"),
        F.col("length").cast("long"), sniff_mime(F.col("content")).alias("sniffed"),
    )


def content_outcome(requests: DataFrame, artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """(canonical_id, role, outcome, key, length, mime): `absent` without a current descriptor,
    `pending` when its blob is missing, else `bytes`."""
    current = artifacts.where("is_current").select("canonical_id", "role", "key", "mime")
    found = requests.join(current, ["canonical_id", "role"], "left").join(blobs, "key", "left")
    outcome = F.when(F.col("key").isNull(), "absent").when(F.col("length").isNull(), "pending").otherwise("bytes")
    return found.select("canonical_id", "role", outcome.alias("outcome"), "key", "length", F.coalesce("mime", "sniffed").alias("mime"))


def content_hash(content: Column) -> Column:
    """A digest that no two contents share in practice; see `fnv1a` for the short one of descriptors."""
    return F.sha2(content, 256)


# Start and factor of the 64-bit FNV-1a hash; the factor is 2^40 + 435.
_FNV_START = (0xCBF29CE4, 0x84222325)
_FNV_FACTOR = 435
_LOW = 0xFFFFFFFF


def fnv1a(content: Column) -> Column:
    """`fnv1a:` and the 64-bit FNV-1a hash of bytes in 16 hexadecimal digits; null of null.

    The product is taken in two halves of 32 bits, so nothing overflows: with h = high * 2^32 + low,
    h * (2^40 + 435) has the low half of low * 435, and above it high * 435, what low * 435 carries, and low * 2^8.
    """
    byte = lambda i: F.conv(F.hex(F.substr(content, i.cast("int"), F.lit(1))), 16, 10).cast("long")

    def step(state: Column, i: Column) -> Column:
        low = state["low"].bitwiseXOR(byte(i))
        product = low * _FNV_FACTOR
        high = state["high"] * _FNV_FACTOR + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(_LOW).alias("high"), product.bitwiseAND(_LOW).alias("low"))

    start = F.struct(F.lit(_FNV_START[0]).cast("long").alias("high"), F.lit(_FNV_START[1]).cast("long").alias("low"))
    places = F.when(F.octet_length(content) > 0, F.sequence(F.lit(1), F.octet_length(content))).otherwise(F.array().cast("array<int>"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    text = F.aggregate(places, start, step, lambda h: F.concat(F.lit("fnv1a:"), half(h["high"]), half(h["low"])))
    return F.when(content.isNotNull(), text)


def derivation_tree(artifacts: DataFrame) -> DataFrame:
    """(canonical_id, role, version, depth, dangling, path, cycle): every artifact under its parent.

    A root has no parent, or one that is not there (`dangling` names it). `path` orders siblings by role, newest
    version first: sort by (canonical_id, path). Pointer jumping: each round doubles how far up an artifact
    sees, so a chain of n takes log2(n) rounds. What no root reaches lies on or below a cycle: `cycle` is true, depth and path null.
    """
    key = ["canonical_id", "role", "version"]
    rows = artifacts.select(*key, "derived_from_role", "derived_from_version")
    up = F.when(F.col("_there"), F.struct(F.col("derived_from_role").alias("role"), F.col("derived_from_version").alias("version")))
    there = rows.select("canonical_id", F.col("role").alias("derived_from_role"), F.col("version").alias("derived_from_version"), F.lit(True).alias("_there")).distinct()
    linked = rows.join(there, ["canonical_id", "derived_from_role", "derived_from_version"], "left")
    label = F.concat(F.col("derived_from_role"), F.lit(" v"), F.col("derived_from_version").cast("string"))
    step = F.struct(F.col("role").alias("role"), (-F.col("version")).alias("newest_first"))
    rounds = Rounds(artifacts.sparkSession)
    state = rounds.step(
        linked.select(
            *key, up.alias("up"), F.when(F.col("_there"), 1).otherwise(0).alias("depth"), F.when(F.col("_there").isNull(), label).alias("dangling"), F.array(step).alias("path")
        )
    )
    total = state.count()  # no path is longer, but on a cycle
    for _ in range(total.bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select("canonical_id", F.struct("role", "version").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        joined = state.join(above, ["canonical_id", "up"], "left")
        state = rounds.step(
            joined.select(
                *key, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), "dangling",
                F.when(F.size("_path") + F.size("path") <= total, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
            )
        )
    lost = F.col("up").isNotNull()
    return state.select(*key, F.when(~lost, F.col("depth")).alias("depth"), "dangling", F.when(~lost, F.col("path")).alias("path"), lost.alias("cycle"))


# ── bibliographic keys ───────────────────────────────────────────────────────

# Words left out of the title part of a key.
TITLE_STOP_WORDS = (
    "a", "an", "the", "of", "on", "in", "at", "to", "for", "and", "or", "nor", "but", "is",
    "are", "was", "were", "be", "been", "being", "with", "from", "by", "as", "into",
)
_ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłľñńňòóôõöøōőŕřśšşťţùúûüūůűųýÿźżžÀÁÂÃÄÅĀĂĄÇĆČĎĐÈÉÊËĒĖĘĚĞÌÍÎÏĪĮİŁĽÑŃŇÒÓÔÕÖØŌŐŔŘŚŠŞŤŢÙÚÛÜŪŮŰŲÝŸŹŻŽ"
_PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiiillnnnoooooooorrsssttuuuuuuuuyyzzzAAAAAAAAACCCDDEEEEEEEEGIIIIIIILLNNNOOOOOOOORRSSSTTUUUUUUUUYYZZZ"


# Greek and Cyrillic letters and how they are written in Latin ones.
_GREEK = dict(zip("αβγδεζηικλμνξοπρςστυω", "abgdeziiklmnxoprsstyo")) | {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps", "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ό": "o", "ύ": "y", "ώ": "o"}
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіёґ", "abvgdeziiklmnoprstufyeieg")) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "є": "ye", "ї": "yi"}
_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "Æ": "AE", "Œ": "OE", "Þ": "Th"}


def romanized(text: Column) -> Column:
    """Latin letters without their marks, Greek and Cyrillic in Latin letters; other scripts stay as they are."""
    single = {k: v for table in (_GREEK, _CYRILLIC) for k, v in table.items() if len(v) == 1}
    single |= {k.upper(): v.upper() for k, v in single.items() if k.upper() not in single}
    several = _PAIRS | {k: v for table in (_GREEK, _CYRILLIC) for k, v in table.items() if len(v) != 1}
    several |= {k.upper(): v.capitalize() for k, v in several.items() if len(k.upper()) == 1 and k.upper() not in several}
    folded = F.translate(text, _ACCENTED + "".join(single), _PLAIN + "".join(single.values()))
    for letter, plain in several.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def surname_part(author: Column) -> Column:
    """The author's words run together, each with a capital; `Anon` where nothing is left."""
    words = F.split(romanized(author), r"[\s-]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    cased = F.transform(bare, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    joined = F.array_join(cased, "")
    return F.when(F.coalesce(F.length(joined), F.lit(0)) > 0, joined).otherwise("Anon")


def title_part(title: Column) -> Column:
    words = F.filter(F.split(F.lower(romanized(F.coalesce(title, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    kept = F.slice(F.filter(words, lambda w: ~w.isin(*TITLE_STOP_WORDS)), 1, 5)
    return (
        F.when(F.size(kept) > 0, F.array_join(kept, "-"))
        .when(F.size(words) > 0, F.get(words, F.lit(0)))
        .otherwise("untitled")
    )


def bibliographic_keys(works: DataFrame) -> DataFrame:
    """(canonical_id, key): surname, `EtAl` for more than one author, year and title words.

    `works`: canonical_id, first_author, n_authors, year, title. Without an author the key begins with `Anon`, without a
    year it has `nd`. The first bearer of a key
    keeps it bare, the next ones take b … z, later ones their number.
    """
    stem = F.concat(
        surname_part(F.col("first_author")), F.when(F.col("n_authors") > 1, "EtAl").otherwise(""),
        F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("-"), title_part(F.col("title")),
    )
    numbered = order_rows(works.select("canonical_id", stem.alias("stem")), ["stem"], ["canonical_id"], "n")
    suffix = (
        F.when(F.col("n") == 1, "")
        .when(F.col("n") <= 26, F.chr(F.col("n") + 96))
        .otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    )
    return numbered.select("canonical_id", F.concat("stem", suffix).alias("key"))
