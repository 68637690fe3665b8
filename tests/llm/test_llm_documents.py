"""Document operators against plain versions, on a frame of edge cases, and on an empty table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import compact_windows, exact_dedup, language_id, minhash_dedup, mixing, packing, quality, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, id string, key int, row string, label double, digest string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(base, places):
    return " ".join(f"x{p}" if k in places else w for k, w in enumerate(base) for p in [k])


@pytest.fixture(scope="module")
def rows():
    base, long = words(120, 1), words(9_000, 2)
    texts = [
        None, None, "", "  \t\n", "one", "One", "one two", "ONE  two", " ".join(base), " ".join(base), "  ".join(base),
        edited(base, {3}), edited(base, {3, 90}), edited(base, {10, 40, 70, 100}), " ".join(words(80, 5) + base[20:90] + words(60, 6)),
        " ".join(long), " ".join(long[:8_990] + ["end"]), "ärger über ñandú é", "a <|endoftext|> b  c\x00 d", "??? 123 !!!",
    ]
    texts += [" ".join(words(60, 100 + k)) for k in range(10)]
    out = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 5 else None, "x", k, "y", 0.5, "z") for k, t in enumerate(texts)]
    return [*out, out[8], (None, "no id here", "en", "s1", "x", 0, "y", 0.5, "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def link_components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_exact_dedup(docs, rows, nothing):
    got = exact_dedup.exact_dedup(docs, hot_texts=2, salts=3, carry=("key",)).collect()
    groups = defaultdict(list)
    body = lambda t: "".join((t or "").split())  # noqa: E731  (the fixture has ASCII white space, and U+00A0 in one text)
    norm = lambda t: body(t) if " " not in (t or "") else t.replace(" ", "")
    for r in rows:
        groups[norm(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        k = norm(text)
        assert (r.keep_id, r.group_size) == (best[k][0], len(groups[k]))
        assert r.text_sha256 == hashlib.sha256(k.encode()).hexdigest()
        kept[k] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("n,percent,bands,lanes,block", [(3, 85, 26, 5, 1024), (5, 80, 32, 4, 4)])
def test_minhash(docs, rows, n, percent, bands, lanes, block):
    got = minhash_dedup.minhash_dedup(docs, words=n, percent=percent, bands=bands, rows=lanes, block=block).collect()
    sets = [(r[0], shingle_set(r[1], n)) for r in rows if r[0] is not None]
    links = [
        (a, b) for a, s in sets for b, t in sets
        if s and t and 100 * len(s & t) >= percent * len(s | t)
    ]
    want = link_components({i for i, _ in sets}, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(dict(sets)[r.doc_id])


def test_circulant_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:700], r.integers(0, 1 << 63, 200, dtype=np.uint64)])
    one, two = (minhash_dedup.circulant_signature(x, 2048) for x in (a, b))
    assert abs((one == two).mean() - 700 / 1100) < 0.05


def test_minhash_of_nothing(nothing):
    assert minhash_dedup.minhash_dedup(nothing).count() == 0


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    packed = packing.pack(docs, window=64).cache()
    got = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        times = sum(r[0] == doc_id for r in rows)
        places = Counter(k for r in by_doc[doc_id] for k in range(r.start, r.start + r.length))
        assert places == Counter({k: times for k in range(len(ids))})
        assert all(r.ids == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids) for r in by_doc[doc_id])
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0 or 64 - end <= packing.PADDING * 64
    whole = packing.sequences(packed).collect()
    assert {r.sequence_id: len(r.ids) for r in whole} == {s: sum(n for _, n in p) for s, p in by_sequence.items()}
    assert packing.pack(nothing).count() == 0


def test_plan_of_sequences_uses_every_piece_once():
    r = random.Random(4)
    histogram = Counter(r.choice([64, 600, 424, r.randrange(1, 1024)]) for _ in range(3_000)) + Counter({1024: 50, 700: 900})
    plan = packing.plan_sequences(histogram)
    for length, count in histogram.items():
        starts = sorted(plan["first_rank"][plan["length"] == length])
        assert starts[0] == 0 and len(set(starts)) == len(starts) and starts[-1] < count


def test_mixing(docs, rows, nothing):
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    total, taken, target = sum(sizes.values()), Counter(), {}
    for r in plan:
        source = None if r.no_source else r.name
        assert r.source_size == sizes[source] and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
        target[source] = r.target
        assert (r.first_position is None) == (r.takes == 0)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    order = sorted((s for s in sizes if s is not None)) + [None]
    free = [s for s in order if target[s] < 3 * sizes[s] - 1e-6]
    unit = {target[s] / (order.index(s) % 3 + 1) for s in free}
    assert max(unit) - min(unit) < 1e-6 * max(unit)
    readings = mixing.curriculum(mixing.mix_plan(docs)).collect()
    assert sum(r.size for r in readings) == sum(taken.values())
    assert [r.position for r in readings] == sorted(r.position for r in readings)
    assert mixing.mix_plan(nothing).count() == 0


def test_mix_comes_near_its_targets(spark):
    r = random.Random(7)
    made = [(k, " ".join(["w"] * r.randrange(1, 200)), f"s{min(r.randrange(12), 5)}") for k in range(3_000)]
    plan = mixing.mix_plan(spark.createDataFrame(made, "doc_id bigint, text string, source string"))
    for row in plan.groupBy("name").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(row["sum(taken)"] - row["max(target)"]) <= min(100, 0.001 * row["max(target)"])  # half the longest document


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F

    knots = [(0.0, 2.0), (0.25, 0.5), (1.0, 1.0)]
    got = spark.range(101).select((F.col("id") / 100).alias("y")).select("y", mixing.time_of_demand(F.col("y"), knots).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    area = np.cumsum(np.interp(grid, [0, 0.25, 1], [2, 0.5, 1]))
    for r in got:
        assert abs(r.t - np.interp(r.y, area / area[-1], grid)) < 1e-4


def test_suffix_array_and_removal(docs, rows, nothing):
    r = random.Random(3)
    for _ in range(100):
        texts = [bytes(r.choice(b"\1\2\3") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 5))]
        got = [texts[x >> 32][x & 0xFFFFFFFF :] for x in suffix_dedup.suffix_array(texts)]
        assert got == sorted(t[i:] for t in texts for i in range(len(t)))
    data = [(x[1] or "").encode() for x in rows]
    for bound in (256, 0, 2):  # 0, 2: anchors are divided by longer grams, down to whole strings or to small arrays
        length, gram = 60, 20
        seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
        result = suffix_dedup.suffix_dedup(docs, length=length, gram=gram, array_segments=bound).collect()
        assert len(result) == len(rows)
        by_id = {x.doc_id: x for x in result}
        for x, d in zip(rows, data, strict=True):
            gone = np.zeros(len(d), bool)
            for k in range(len(d) - length + 1):
                if seen[d[k : k + length]] > 1:
                    gone[k : k + length] = True
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()
            got = by_id[x[0]]
            assert (got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256) == (len(d), gone.sum(), spans, kept)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_near_passages(docs, rows, nothing):
    got = compact_windows.near_passages(docs).collect()
    text = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    for r in got:
        a, b = (
            {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            for w in (text[r.doc_id][r.begin : r.stop], text[r.other_id][r.other_begin : r.other_stop])
        )
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8
        assert r.stop - r.begin >= 50
    places = defaultdict(set)
    for i, w in text.items():
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add(i)
    must = set().union(*[s for s in places.values() if len(s) > 1])
    assert must and must <= {r.doc_id for r in got} | {r.other_id for r in got}
    assert compact_windows.near_passages(nothing).count() == 0


def test_compact_windows_cover_every_subsequence_once():
    values, least = np.random.default_rng(1).permutation(40).astype(np.uint64), 5
    found = compact_windows.compact_windows(values, least)
    for i in range(40):
        for j in range(i + least - 1, 40):
            at = i + int(np.argmin(values[i : j + 1]))
            assert [(l, c, h) for l, c, h in found if l <= i <= c <= j <= h] == [x for x in found if x[1] == at]
            assert sum(l <= i <= c <= j <= h for l, c, h in found) == 1


def test_language(spark, docs, rows, nothing):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.where("lang IS NULL")).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_bound_vectors_are_nearly_orthogonal():
    made = language_id.Vectors()
    keys, _ = language_id.trigrams("hyperdimensional")
    rows = made.of(keys).astype(float)
    cosines = rows @ rows.T / rows.shape[1]
    assert np.abs(cosines - np.eye(len(keys))).max() < 0.2


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(2)
    score = r.normal(size=3_000)
    grade = np.digitize(score + 0.3 * r.logistic(size=3_000), [-1.0, 0.5])
    index = np.tile([0, 1], 3_000)
    value = np.stack([score, np.ones(3_000)], axis=1).ravel()
    model = quality.fit(index, value, np.arange(0, 6_000, 2), grade, 3, size=4, penalty=0.01)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(score * model.weights[0] + model.weights[1])
    assert (tails[:, 0] >= tails[:, 1]).all()
    predicted = (tails > 0.5).sum(axis=1)
    assert (predicted == grade).mean() > 0.75


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame(
        [(k, int(k % 2 == 0), int(k % 6 == 0)) for k in range(20)] + [(None, 1, 0), (3, None, None), (999, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in got)
    assert quality.classify(nothing, labels).count() == 0
    assert all(r.kept for r in quality.classify(docs, labels.where("false")).collect())


def test_quality_on_held_out_ratings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.9 * len(good) and sum(poor) <= 0.2 * len(poor)
