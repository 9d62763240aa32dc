"""Resolution against a row-by-row brute force, and properties of the similarity joins."""

import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from plinth.functions.text import name_aliases, normalize_name
from plinth import session
from plinth.operators import resolve, simjoin
from plinth.plans import catalog
from plinth.schema import entity_id
from plinth.functions.text import slug_of

WORDS = ["alpha", "alphas", "beta", "betas", "gamma", "gama", "delta", "studio", "lab", "north", "norths", "works", "bau", "haus", "ab", "ac"]


def grams(name):
    out = set()
    for word in re.findall(r"[^\W_]+", name.lower()):
        padded = f"  {word} "
        out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
    return out


def sim(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def one_by_one(rows, targets, aliases, minted, forms):
    """(pos, normalized) in order; the visible world grows as names create entities."""
    known = [(str(i), n) for i, n in targets]
    alias_of = dict(aliases)
    out = {}
    for pos, name in rows:
        exact = sorted(i for i, n in known if n == name)
        if exact:
            out[pos] = ("exact", exact[0])
            continue
        if name in alias_of:
            out[pos] = ("alias", alias_of[name])
            continue
        near = sorted((-sim(name, n), i) for i, n in known)
        score, best = (-near[0][0], near[0][1]) if near else (0.0, None)
        if score >= 0.85:
            out[pos] = ("trigram", best)
        elif score >= 0.6:
            out[pos] = ("review", best)
        else:
            out[pos] = ("new", minted[name])
            known.append((minted[name], name))
            for alias in forms[name]:
                if alias:
                    alias_of.setdefault(alias, minted[name])
    return out


def test_batch_equals_one_by_one(spark):
    rng = random.Random(7)
    for trial in range(3):
        make = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 2, 3])))
        target_rows = [(f"t{i:02d}", make()) for i in range(8)]
        alias_rows = [("t00", "person", "zz", make()), ("t01", "person", "yy", "ab")]
        rows = [(i, make()) for i in range(90)]
        targets = spark.createDataFrame(target_rows, "id string, canonical_name string")
        aliases = spark.createDataFrame(alias_rows, "entity_id string, entity_type string, alias string, alias_normalized string")
        candidates = spark.createDataFrame(rows, "pos long, name string")
        info = candidates.select(
            normalize_name("name").alias("n"), entity_id("person", slug_of(normalize_name("name"))).alias("id"),
            F.transform(name_aliases(normalize_name("name")), lambda a: normalize_name(a)).alias("forms")).distinct().collect()
        minted, forms = {r["n"]: r["id"] for r in info}, {r["n"]: r["forms"] for r in info}
        owner = {}
        for row in alias_rows:
            owner[row[3]] = min(owner.get(row[3], row[0]), row[0])
        expected = one_by_one(rows, target_rows, owner, minted, forms)
        # Tiny blocks, so that names meet creators of earlier blocks as well as names of their own.
        got = resolve.resolve_batch(candidates, targets, aliases, "person", block=[8, 30, 4096][trial]).collect()
        assert len(got) == len(rows)
        found = {r["pos"]: (r["match_type"], r["entity_id"] or r["suggested_id"]) for r in got}
        assert found == expected, f"trial {trial}"


def test_resolve_stages_are_disjoint_and_cover(spark):
    targets = spark.createDataFrame(
        [("1", "foster and partners", None, "Q1"), ("2", "acme", "1", None)],
        "id string, canonical_name string, merged_into string, wikidata_id string")
    aliases = spark.createDataFrame([("1", "firm", "FP", "fp")], "entity_id string, entity_type string, alias string, alias_normalized string")
    rows = [("Foster + Partners", None), ("FP Ltd", None), ("Foster and Partner", None), ("Foster Part", None), ("Acme Inc", None), ("Anything", "Q1")]
    got = resolve.resolve(
        spark.createDataFrame(rows, "name string, wikidata_id string"), targets, aliases, "firm", id_column="wikidata_id").collect()
    kinds = {r["name"]: r["match_type"] for r in got}
    assert kinds == {"Foster + Partners": "exact", "FP Ltd": "alias", "Foster and Partner": "trigram", "Foster Part": "new",
                     "Acme Inc": "new", "Anything": "wikidata"}
    assert all((r["confidence"] == 0.0) == (r["match_type"] == "new") for r in got)


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for threshold in (0.3, 0.5, 0.85, 0.95):
        got = {(r[0], r[1]) for r in simjoin.similar_pairs_within(df, threshold, "name").collect()}
        want = {(a, b) for a in names for b in names if a < b and sim(a, b) > threshold}
        assert got == want


def test_no_pair_comparison_in_plans(spark):
    df = spark.createDataFrame([("a b",), ("b c",)], "name string")
    targets = df.select(F.monotonically_increasing_id().alias("id"), F.col("name").alias("canonical_name"))
    for frame in (simjoin.similar_pairs_within(df, 0.5, "name"), simjoin.match_trigram(df, targets, "name"),
                  simjoin.match_mentions(df.withColumn("title", F.lit("x")), targets, "name", "title")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_mentions_are_all_names_or_the_longest(spark):
    titles = spark.createDataFrame([(1, "New tower by Alpha Works Berlin"), (2, "alphaworks"), (3, "nothing")], "k int, t string")
    firms = spark.createDataFrame([(7, "alpha"), (8, "alpha works"), (5, "alpha works"), (9, "new")], "id int, canonical_name string")

    def found(best):
        return {(r["k"], r["id"], r["canonical_name"]) for r in simjoin.match_mentions(titles, firms, "k", "t", best=best).collect()}

    assert found(False) == {(1, 5, "alpha works"), (1, 7, "alpha"), (2, 7, "alpha")}
    assert found(True) == {(1, 5, "alpha works"), (2, 7, "alpha")}


def test_all_lines_of_documents_meet_page_titles(spark, tmp_path):
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if path.name not in ("documents.parquet", "pages.parquet"):
            (tmp_path / path.name).symlink_to(path)
    spark.createDataFrame([(1, "first line\nsecond\ngreat page titles", "en", "a", 30), (2, None, "en", "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "<title>Great page title</title>")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog()["documents_like_page_titles"].run(spark, str(tmp_path)).collect()
    assert [(r.left_name, r.right_name) for r in found] == [("great page titles", "Great page title")]


def _brute(left, right, t, within=False):
    return {(a, b, round(sim(a, b), 9)) for a in left for b in right if sim(a, b) > t and (not within or a < b)}


def test_both_ways_of_the_similarity_join_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 16])))
    left, right = ({name() for _ in range(150)} | {"", "!!"} for _ in range(2))
    a, b = (spark.createDataFrame([(n,) for n in names] + [(None,)], "name string") for names in (left, right))
    taken = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    # All by blocks, of which there are many; then all by prefixes.
    for settings in ({"BLOCK_ROWS": 20}, {"FEW_PAIRS": 0, "MEETING_COST": 0}):
        with monkeypatch.context() as m:
            for key, value in settings.items():
                m.setattr(simjoin, key, value)
            for t in (0.3, 0.6):
                assert taken(simjoin.similar_pairs(a, b, t, "name", "name")) == sorted(_brute(left, right, t))
                assert taken(simjoin.similar_pairs_within(a, t, "name")) == sorted(_brute(left, left, t, True))


def test_blocks_count_shared_grams_by_bits_and_name_their_pairs(spark, monkeypatch):
    """64 pairs a word, in few words and small batches; pairs leave a block with their names, so nothing is joined to them."""
    rng = random.Random(7)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 4, 8, 20])))
    left, right = {name() for _ in range(300)}, {name() for _ in range(90)} | {"\u00dcber die Br\u00fccke", "\u6771\u4eac \u5927\u5b66"}
    for key, value in {"BITS_WORDS": 2, "BATCH_WORDS": 5, "PAIRS_OF_A_BATCH": 7}.items():
        monkeypatch.setattr(simjoin, key, value)
    a, b = (spark.createDataFrame([(n,) for n in sorted(names)], "name string") for names in (left, right))
    for t, inclusive in ((0.3, False), (0.5, True), (0.9, True)):
        found = simjoin.similar_pairs(a, b, t, "name", "name", inclusive)
        want = {(x, y, round(sim(x, y), 9)) for x in left for y in right if (sim(x, y) >= t if inclusive else sim(x, y) > t)}
        assert sorted((r[0], r[1], round(r[2], 9)) for r in found.collect()) == sorted(want)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    within = simjoin.similar_pairs_within(a, 0.3, "name")
    assert sorted((r[0], r[1], round(r[2], 9)) for r in within.collect()) == sorted(_brute(left, left, 0.3, True))


def test_similarity_join_ships_no_grams_with_each_prefix_gram(spark):
    """Long lines against short names: what is written stays near the size of the sets."""
    lines = spark.range(40).selectExpr("concat_ws(' ', transform(sequence(1, 60), i -> substr(md5(cast(id * 100 + i as string)), 1, 6))) as line")
    sets = simjoin._numbered(lines, "line")
    counts = simjoin.gram_frequencies(sets, "_grams")
    one = simjoin.rare_first(sets, "_grams", counts).select("*", *simjoin.signatures("_grams"))
    for side in simjoin._postings(one, one, 0.3, True, counts, counts):
        assert not any(f.dataType.typeName() in ("array", "string") for f in side.schema)


def test_near_copies_of_a_batch_are_not_compared_with_each_other(spark, monkeypatch):
    """1,500 names, all alike: only those of the first block are one edge list."""
    compared, within = [], simjoin.similar_pairs_within

    def counted(names, *args, **options):
        compared.append(names.count())
        return within(names, *args, **options)

    monkeypatch.setattr(resolve, "similar_pairs_within", counted)
    fresh = spark.range(1, 1501).selectExpr("concat('supplier', lpad(cast(id as string), 9, '0'), ' and co') as normalized", "id as first")
    made = [r["normalized"] for r in resolve.batch_creators(fresh).collect()]
    assert made == ["supplier000000001 and co"]
    assert compared == [1024, 0]


def test_mentions_meet_words_and_names_with_spaces(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "\n", "."]) for _ in range(12))) for i in range(40)] + [(40, None), (41, "")]
    names = [(1, "alpha"), (2, "alpha"), (3, "lphas"), (4, "studio lab"), (5, "north works"), (6, "gamma\nbeta"), (7, "beta"), (8, "a.alphasx"), (9, "norths. delta"), (10, "studiox")]
    looked, held = [], simjoin._held

    def counted(lowered, key, *args):
        looked.append((key, lowered.count()))
        return held(lowered, key, *args)

    monkeypatch.setattr(simjoin, "_held", counted)
    found = simjoin.match_mentions(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(names, "id long, canonical_name string"), "k", "t")
    first = {n: i for i, n in reversed(names)}
    assert sorted(map(tuple, found.collect())) == sorted((k, i, n) for k, t in texts if t for n, i in first.items() if len(n) >= 5 and n in t)
    # Names without a space are looked for in each distinct word once, not in each text.
    words = {w for _, t in texts if t for w in re.split("[ \n]", t) if len(w) >= 5}
    assert looked == [("_word", len(words)), ("k", len(texts))]


def test_marks_of_many_filed_names_still_drop_other_grams(spark):
    """Half a million names leave most bits unset, so what is shuffled does not grow with texts times names."""
    filed = spark.range(500_000).select(F.concat(F.lit("n"), "id").alias("_gram"))
    bits = session.write_once(simjoin.filed_bits(filed))
    assert len(bits.first()["bits"]) == simjoin.FILED_WORDS <= 1 << 16
    passed = lambda grams: grams.where(simjoin.maybe_filed(F.col("_gram"), bits.scalar())).count()
    assert passed(filed) == 500_000
    assert passed(spark.range(100_000).select(F.concat(F.lit("other"), "id").alias("_gram"))) < 20_000
