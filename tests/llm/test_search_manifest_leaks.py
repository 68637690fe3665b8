"""Ranked search, manifest and decontamination against plain versions, on edge cases and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, lexical_search, merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, item bigint, row string, id string, position int, tree int, words string"
ITEMS = "item_id string, text string, term int, position int, row int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lower(text))


def prose(n, seed, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"{r.choice('wvWé')}{min(int(r.expovariate(0.08)), vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def items():
    out = [(f"i{k}", prose(9 + 5 * k, 500 + k)) for k in range(9)]
    out += [("i1", out[3][1]), (None, prose(30, 77)), ("none", None), ("blank", " .,- "), ("short", "W1, v2"), ("one", "w3"), ("unseen", "zzz yyy")]
    return [(a, b, 1, 2, 3) for a, b in out]


@pytest.fixture(scope="module")
def rows(items):
    texts = [None, "", " \n\t", "w1", "É ÉÉ é", "w1 w1-w1,W1", prose(30_000, 9), items[2][1], f"{items[4][1]}! {items[5][1]}"]
    texts += [f"{prose(20, k)} {items[k % 9][1].upper()} {prose(20, k + 50)}" for k in range(12)]
    texts += [f"{prose(15, k)} {' '.join(items[k % 9][1].split()[2:15])} {prose(25, k + 90)}" for k in range(12)]
    texts += [prose(40, 1000 + k % 7) for k in range(30)]
    r, out = random.Random(3), []
    for k, text in enumerate(texts):
        lang, source = r.choice([None, "de", "en", "é", "zh"]), r.choice([None, "a:b", ""])
        out.append((k, text, lang, source, None if k % 9 == 0 else k, 5, "r", "x", 1, 2, "w"))
    return [*out, out[10], out[10], (None, prose(50, 4), None, None, 7, 1, "r", "x", 1, 2, "w")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def asked(spark, items):
    return spark.createDataFrame(items, ITEMS).repartition(2)


def plain_search(rows, items, top):
    held = [(r[0], Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in items:
        found = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(item[1]) if t in c
            )
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item[0], k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("top", "block", "postings"), [(20, 1024, 500_000), (5, 3, 60), (200, 100, 1)])
def test_search_equals_scoring_every_document(docs, asked, rows, items, top, block, postings):
    got = lexical_search.search(docs, asked, top=top, items_per_block=block, shard_postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(rows, items, top)


def test_ties_go_by_id(spark, asked):
    same = spark.createDataFrame([(1000 - k, "w3 w4" if k % 2 else "w9") for k in range(300)], "doc_id bigint, text string").repartition(6)
    got = lexical_search.search(same, asked, shard_postings=50).where("item_id = 'one'").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [701 + 2 * k for k in range(20)]


def test_range_maximum_over_all_ranges():
    import numpy as np

    r = np.random.default_rng(5)
    impact = r.integers(0, 9, 37)
    shard = lexical_search.Shard(np.arange(37), np.zeros(37, np.int64), np.arange(37), impact)
    low, high = np.array([(a, b) for a in range(37) for b in range(a, 38)]).T
    value, at = shard.range_maximum(low, high)
    for a, b, v, p in zip(low, high, value, at, strict=True):
        assert v == (impact[a:b].max() if b > a else 0) and (b == a or (impact[p] == v and a <= p < b))


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(nodes):
    """Root, and per leaf its siblings and the way the root follows from another digest."""
    siblings, at, layer = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(layer) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            siblings[k].append((p & 1, layer[other] if other < len(layer) else None))
            at[k] = p >> 1
        layer = [sha("".join(layer[k : k + 2])) for k in range(0, len(layer), 2)]
    return layer[0], siblings


def climb(digest, way):
    for right, other in way:
        digest = sha(digest) if other is None else sha(other + digest) if right else sha(digest + other)
    return digest


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_a_plain_tree(docs, rows, levels):
    edited = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs, fields, "lang", "doc_id", {"n_chars": edited}, levels=levels).collect()
    leaves = defaultdict(list)
    for doc, text, lang, source, n_chars, *_ in rows:
        told_as = lambda n: sha("".join(map(told, (doc, source, lang, n, text))))  # noqa: B023, E731
        other = n_chars + 1 if n_chars is not None and doc is not None and doc % 3 == 0 else n_chars
        leaves[lang].append((doc is not None, doc or 0, told_as(n_chars), told_as(other)))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = [joined([x[2] for x in sorted(leaves[lang])]) for lang in langs]
    root, over = joined([t[0] for t in trees])
    wanted = Counter()
    for k, lang in enumerate(langs):
        for leaf, way in zip(sorted(leaves[lang]), trees[k][1], strict=True):
            proof = sha("".join(o for _, o in way + over[k] if o))
            wanted[(leaf[1] if leaf[0] else None, lang, leaf[2], trees[k][0], root, proof, climb(leaf[3], way + over[k]))] += 1
    assert Counter((r.doc_id, r.lang, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256, r.folded_root.hex()) for r in got) == wanted
    assert all(merkle.folded(bytes(r.leaf), bytes(r.path)) == r.root for r in got)
    assert any(r.folded_root != r.root for r in got)


def test_manifest_of_one_row_and_of_none(docs):
    one = merkle.manifest(docs.where("doc_id = 3"), ["doc_id", "text"], "lang", "doc_id").collect()
    assert [r.leaf == r.root and r.path == b"" and r.proof_sha256 == sha("") for r in one] == [True]
    assert merkle.manifest(docs.where("doc_id < 0"), ["doc_id", "text"], "lang", "doc_id").count() == 0


def plain_spans(rows, items, window):
    out = Counter()
    for doc, text, *_ in rows:
        words, hit, owners = terms(text), set(), set()
        for name, item_text, *_ in items:
            wanted = terms(item_text)
            n = min(window, len(wanted))
            windows = {tuple(wanted[k : k + n]) for k in range(len(wanted) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    owners.add(name or "")
        runs = [k for k in sorted(hit) if k - 1 not in hit]
        ends = [k + 1 for k in sorted(hit) if k + 1 not in hit]
        out[(doc, len(words), tuple(zip(runs, ends, strict=True)), tuple(sorted(owners)))] += 1
    return out


@pytest.mark.parametrize(("window", "shingle"), [(10, 4), (4, 1), (3, 3)])
def test_contamination_equals_comparing_every_window(docs, asked, rows, items, window, shingle):
    got = decontaminate.contamination(docs, asked, window=window, shingle=shingle).collect()
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in got) == plain_spans(rows, items, window)


def test_empty_tables(docs, asked):
    no_docs, no_items = docs.where("doc_id < 0"), asked.where("item_id = '?'")
    assert lexical_search.search(no_docs, asked).count() == lexical_search.search(docs, no_items).count() == 0
    assert lexical_search.search(docs, asked.where("item_id IN ('blank', 'unseen')")).count() == 0
    assert decontaminate.contamination(no_docs, asked).count() == 0
    clean = decontaminate.contamination(docs, no_items).collect()
    assert len(clean) == docs.count() and not any(r.spans or r["items"] for r in clean)
