"""Vector and page operators, and the pipeline, against plain versions."""

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import common, embedding_dedup, html_extract


def test_embedding_links(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 16))
    vectors = [c + 0.12 * r.normal(size=16) for c in centre for _ in range(40)] + list(r.normal(size=(200, 16)))
    made = [(k, [float(x) for x in v], "a") for k, v in enumerate(vectors)]
    made += [(900, made[0][1], "b"), (901, [2 * x for x in made[0][1]], "b"), (902, None, "b"), (903, [0.0] * 16, "b"), (904, [], "b")]
    made += [(905, [float("nan")] * 16, "b"), (906, [None] * 16, "b"), (907, [1.0, 2.0], "b"), (908, [2.0, 4.0], "b"), made[3], (None, made[3][1], "c")]
    table = spark.createDataFrame(made, "vec_id bigint, embedding array<double>, id string").repartition(3)
    got = embedding_dedup.embedding_dedup(table, block=16).collect()
    assert len(got) == len(made)

    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    units = [unit(v) for _, v, _ in made]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    count = {}
    parent = list(range(len(made)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(units):
        count[made[i][0]] = sum(near(a, b) for j, b in enumerate(units) if j != i)
        for j in range(i):
            if near(a, units[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (vec_id, _, _) in enumerate(made):
        if vec_id is not None:
            least[find(k)] = min(least.get(find(k), vec_id), vec_id)
    total = found = 0
    for row in got:
        total += count[row.vec_id]
        found += row.n_links
        assert row.n_links <= count[row.vec_id]
    assert found >= 0.99 * total > 0
    for k, (vec_id, _, _) in enumerate(made):
        if vec_id is not None and vec_id >= 900:
            row = next(r for r in got if r.vec_id == vec_id)
            assert row.component_id == least[find(k)]
    assert embedding_dedup.embedding_dedup(table.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{x:1}}</style><script>var a="</p>";</script></head><body class="page">
<nav><ul><li><a href=/>Home {t}</a><li>About</ul></nav><div class="cookie-notice">We use cookies {t}</div><header><p>Site {t}</p></header>
{body}<aside>Also {t}</aside><form><p>Write to us</p></form><footer>&copy; {t}</footer>"""
ARTICLE = """<article><h1>Title {t} &amp; more</h1><p>First &lt;b&gt;{t}<br>line
   two<p>Second <i>part {t}</i> here<div class="ad">Buy {t}</div><ul><li>one<li>two {t}</ul><div id="comments"><p>Nice {t}</p></div></article>"""
BARE = """<div class=wrap><div class=tag>Always the same</div><div class=text><h2>Head {t}</h2><p>Words {t} are here.</p><p>{t} ends.</p></div></div>"""


def test_extraction(spark):
    made = [(k, f"https://One.example.org/{k}?x", PAGE.format(t=f"t{k}", body=ARTICLE.format(t=f"t{k}"))) for k in range(8)]
    made += [(20 + k, f"http://two.example.org/{k}", PAGE.format(t=f"t{k}", body=BARE.format(t=f"t{k}"))) for k in range(8)]
    made += [(40, None, None), (41, "", ""), (42, "x", "just text &eacute; here"), (43, "http://three.example.org", "<p>unclosed <b>bold"), (None, "http://three.example.org", "<!-- open <p>x</p>")]
    table = spark.createDataFrame([(*m, "z") for m in made], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.extract(table).collect()}
    assert len(got) == len(made)
    for k in range(8):
        t = f"t{k}"
        want = [f"Title {t} & more", f"First <b>{t} line two", f"Second part {t} here", "one", f"two {t}"]
        assert got[k].text == "\n\n".join(want) and got[k].n_chars == len(got[k].text)
        assert got[20 + k].text == f"Head {t}\n\nWords {t} are here.\n\n{t} ends."
    assert (got[40].text, got[41].text, got[42].text, got[43].text, got[None].text) == ("", "", "just text é here", "unclosed bold", "")
    assert html_extract.extract(table.where("false")).count() == 0


def test_simple_tree_matching_keeps_order():
    def tree(text):
        t = html_extract.unfolded(text)
        html_extract.listed(t)
        return t

    match = html_extract.simple_tree_matching(tree("a.(b. c.(d. e.) f.)"), tree("a.(c.(e.) b. f.)"))
    assert match == {0: 0, 2: 1, 4: 2, 5: 4}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline_on_a_small_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == table.columns
        if name == "quality classifier":
            assert docs.exceptAll(before).isEmpty()
        if name == "exact dedup":
            texts = ["".join((r.text or "").split()) for r in docs.collect()]
            assert len(texts) == len(set(texts)) and set(texts) == {"".join((r.text or "").split()) for r in before.collect()}
        if name == "minhash near-dedup":
            def shingles(t):
                w = (t or "").encode().lower().split()
                return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            kept = {r.doc_id for r in docs.collect()}
            for i, s in sets.items():
                near = {j for j, t in sets.items() if s and t and 10 * len(s & t) >= 8 * len(s | t)}
                assert i in kept or any(j < i for j in near)
                assert not {j for j in near if j != i} <= set() or i in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    lengths = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    times = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["sum(length)"] for r in lengths} == {r.doc_id: times[r.doc_id] * r["max(doc_tokens)"] for r in lengths}


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, place):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", None, 0),
            (2, "a b c", "en", "s", 5), (3, " ".join(["long"] * 30_000), "en", "s", 1)]
    name, stage = corpus_pipeline.STAGES[place]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row_", "'x' AS graded", "2 AS id", "3 AS reading", "4 AS reading_", "5 AS graded_")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.count() >= 0
    if place < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_near_copies_without_ids_and_with_shared_ids(spark):
    base = [f"w{k}" for k in range(100)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (10, 50, 90)]
    rows = [(None, near[0]), (7, near[1]), (7, near[2]), (3, near[0]), (None, "alone here"), (None, None), (9, "nothing like it at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, "alone here"), (0, ""), (3, near[0]), (9, rows[6][1])])


def test_temporary_tables_go_and_results_stay(spark):
    seen = []

    def make():
        middle = common.written(spark.range(10).toDF("n"), "middle")
        seen.append(middle)
        return middle.where("n > 4")

    assert common.settled(make, spark, "kept").count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(seen[0].inputFiles()[0]).count()
