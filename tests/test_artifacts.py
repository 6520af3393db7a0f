from pyspark.sql import functions as F

from citegraph.operators import artifacts
from tests.helpers import rows


def test_versions_continue_and_only_the_newest_is_current(spark):
    first = artifacts.record_artifacts(spark.createDataFrame([("n", "abstract", 1), ("n", "abstract", 2), ("n", "fulltext", 3)], "canonical_id string, role string, seq int"))
    second = artifacts.record_artifacts(spark.createDataFrame([("n", "abstract", 9)], "canonical_id string, role string, seq int"), first)
    assert rows(second, "key", "is_current") == [
        ("n/abstract/v1", False), ("n/abstract/v2", False), ("n/abstract/v3", True), ("n/fulltext/v1", True)
    ]
    listed = artifacts.list_artifacts(second, role="abstract", all_versions=True).collect()
    assert [r["version"] for r in listed] == [3, 2, 1]


def test_tree_orders_children_and_marks_dangling(spark):
    held = spark.createDataFrame(
        [("n", "fulltext", 1, None, None), ("n", "fulltext", 2, None, None), ("n", "pages", 1, "fulltext", 2), ("n", "chunks", 1, "pages", 1), ("n", "outline", 1, "pages", 7)],
        "canonical_id string, role string, version int, derived_from_role string, derived_from_version int",
    )
    tree = artifacts.derivation_tree(held).orderBy("canonical_id", "path").collect()
    assert [(r["depth"], r["role"], r["version"], r["dangling"]) for r in tree] == [
        (0, "fulltext", 2, None), (1, "pages", 1, None), (2, "chunks", 1, None), (0, "fulltext", 1, None), (0, "outline", 1, "pages v7")
    ]


def test_deep_chains_and_cycles(spark):
    chain = [("c", "step", k, "step" if k else None, k - 1 if k else None) for k in range(1000)]
    ring = [("r", "a", 1, "b", 1), ("r", "b", 1, "a", 1), ("r", "c", 1, "b", 1)]
    tree = artifacts.derivation_tree(spark.createDataFrame(chain + ring, "canonical_id string, role string, version int, derived_from_role string, derived_from_version int"))
    depth = {r["version"]: (r["depth"], len(r["path"]), r["cycle"]) for r in tree.where("canonical_id = 'c'").collect()}
    assert depth == {k: (k, k + 1, False) for k in range(1000)}
    assert rows(tree.where("canonical_id = 'r'"), "role", "depth", "cycle") == [("a", None, True), ("b", None, True), ("c", None, True)]


def test_outcomes_and_sniffing(spark, tmp_path):
    (tmp_path / "n" / "fulltext").mkdir(parents=True)
    (tmp_path / "n" / "fulltext" / "v1").write_bytes(b"%PDF-1.4 ...")
    held = spark.createDataFrame(
        [("n", "fulltext", "n/fulltext/v1", None, True), ("m", "fulltext", "m/fulltext/v1", "text/plain", True)],
        "canonical_id string, role string, key string, mime string, is_current boolean",
    )
    asked = spark.createDataFrame([("n", "fulltext"), ("m", "fulltext"), ("n", "abstract")], "canonical_id string, role string")
    got = artifacts.content_outcome(asked, held, artifacts.blob_listing(spark, str(tmp_path)))
    assert rows(got, "canonical_id", "role", "outcome", "length", "mime") == [
        ("m", "fulltext", "pending", None, "text/plain"), ("n", "abstract", "absent", None, None), ("n", "fulltext", "bytes", 12, "application/pdf")
    ]


def test_bibliographic_keys(spark):
    works = spark.createDataFrame(
        [("a", "José García-Márquez", 2, 1999, "The State of the Art: a Survey"), ("b", "José García-Márquez", 2, 1999, "State of Art – survey"),
         ("c", "Müller", 1, 2001, "Of the"), ("d", "Ødegård", 1, 2002, "«»"), ("e", "Юрий Жуков", 1, 1980, "О числах"), ("f", "Ἀριστοτέλης Θωμάς", 1, None, "Λόγος"),
         ("g", "山田 太郎", 1, 1990, "数の本"), ("h", None, 1, None, None)],
        "canonical_id string, first_author string, n_authors int, year int, title string",
    )
    assert rows(artifacts.bibliographic_keys(works)) == [
        ("a", "JoseGarciaMarquezEtAl1999-state-art-survey"), ("b", "JoseGarciaMarquezEtAl1999-state-art-surveyb"), ("c", "Muller2001-of"), ("d", "Odegard2002-untitled"),
        ("e", "YuriiZhukov1980-o-chislakh"), ("f", "ἈristotelisThomasnd-logos"), ("g", "山田太郎1990-数の本"), ("h", "Anonnd-untitled")
    ]


def test_fnv1a_vectors_and_brute_force(spark):
    # Published test vectors of the 64-bit FNV-1a hash.
    vectors = {b"": "cbf29ce484222325", b"a": "af63dc4c8601ec8c", b"foobar": "85944171f73967e8"}
    contents = [*vectors, bytes(range(256)), "naïve ß".encode(), b"\xff" * 5000]

    def plain(content):
        h = 0xCBF29CE484222325
        for byte in content:
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return f"fnv1a:{h:016x}"

    assert all(plain(c) == f"fnv1a:{v}" for c, v in vectors.items())
    frame = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(contents)] + [(99, None)], "k int, content binary")
    got = {r["k"]: r["h"] for r in frame.select("k", artifacts.fnv1a(F.col("content")).alias("h")).collect()}
    assert got == {k: plain(c) for k, c in enumerate(contents)} | {99: None}
