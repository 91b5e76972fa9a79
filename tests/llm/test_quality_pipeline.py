"""op2 and the pipeline: held-out accuracy, and each stage against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import quality, simhash
from quillspark.llm import queries as Q

from .conftest import data

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in Q.op2_quality(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [k for k in labels if k in scored and quality.held_out(k)]
    assert len(held) > 40
    assert sum(scored[k].predicted == labels[k] for k in held) / len(held) >= 0.95
    good, bad = [scored[k].score for k in held if labels[k]], [scored[k].score for k in held if not labels[k]]
    assert np.mean(good) > 0.8 and np.mean(bad) < 0.2


def test_scores_are_sound(scored):
    for k, r in scored.items():
        assert r.held_out == quality.held_out(k) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_do_not_count(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    turned = [(r.doc_id, 1 - r.quality if quality.held_out(r.doc_id) else r.quality) for r in labels]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = quality.classify(docs, spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    assert all(abs(r.score - scored[r.doc_id].score) < 1e-3 for r in again)


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.classify(empty, labels).collect() == []
    assert quality.good_documents(odd, none).count() == odd.count()


def _plain_statistics(text):
    """The statistics once more, character by character and word by word."""
    data = text.encode()
    if not data:
        return [0.0] * 25
    of = lambda f: sum(map(f, data)) / len(data)
    marks = b".,;:'\"?()-"
    space, lower, upper, digit = (lambda c: chr(c).isspace() and c < 128, lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57)
    symbol = lambda c: c < 128 and not (lower(c) or upper(c) or digit(c) or space(c) or c == 33 or c in marks)
    words, lines = text.split(), text.split("\n")
    n = len(words) or 1
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    big = [w for w in words if w.isupper() and len(w) > 1]
    return [
        np.log(1 + len(text)), np.log(1 + n), mean, (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5, of(symbol), of(lower), of(upper), of(digit), of(space), of(lambda c: c in marks), of(lambda c: c > 127), of(lambda c: c == 33),
        -sum(data.count(c) / len(data) * np.log2(data.count(c) / len(data)) for c in set(data)), len(set(words)) / n, len(set(words)) / n**0.5, max([words.count(w) for w in set(words)], default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(not (w[-1].isalnum() or w[-1] in ".,;:?'\")") for w in words) / n, len(big) / n, sum(w[0].isupper() for w in words if w not in big) / n,
        np.log(1 + len(lines)), np.log(1 + len(text) / len(lines)), len(set(lines)) / len(lines), sum(s > 12 for s in sizes) / len(sizes), sum(s < 3 for s in sizes) / len(sizes),
    ]


def test_scores_are_those_of_brute_force(spark, scored):
    """All labelled rows in one matrix, least squares with a penalty, the isotonic fit by its minimax formula."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stats = {k: np.array(_plain_statistics(t)) for k, t in texts.items() if len(t) < 20_000}
    stats |= {k: np.array(quality.statistics(t)) for k, t in texts.items() if k not in stats}
    told = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality is not None and r.doc_id in texts:
            told[r.doc_id].append(r.quality)
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    fit, rest = [[k for k in sorted(told) if fold(k) in f] for f in ((1, 2, 3), (4,))]
    x, y = np.array([stats[k] for k in fit]), np.array([np.mean(told[k]) for k in fit])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    w, b = quality._directions(25)
    features = lambda ks: np.array([[*(np.cos(np.clip((stats[k] - mean) / np.where(sd > 0, sd, 1), -8, 8) @ w + b) * (2 / 256) ** 0.5), 1] for k in ks])
    design, penalty = features(fit), (quality.RIDGE * len(fit) / 256) ** 0.5
    weights = np.linalg.lstsq(np.vstack([design, penalty * np.eye(257)]), np.concatenate([y, np.zeros(257)]), rcond=None)[0]
    cells = defaultdict(list)
    for k, raw in zip(rest, features(rest) @ weights, strict=True):
        cells[min(max(int(np.floor((raw + 0.5) / 2 * 512)), 0), 511)].append(np.mean(told[k]))
    at = sorted(cells)
    average = lambda i, j: sum(map(sum, (cells[c] for c in at[i : j + 1]))) / sum(len(cells[c]) for c in at[i : j + 1])
    level = [max(min(average(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    want = np.clip(np.interp(features(sorted(texts)) @ weights, [(c + 0.5) / 512 * 2 - 0.5 for c in at], level), 0, 1)
    got = np.array([scored[k].score for k in sorted(texts)])
    assert np.abs(got - want).max() < 0.02 and np.abs(got - want).mean() < 1e-4
    assert np.mean([(g >= 0.3) == (v >= 0.3) for g, v in zip(got, want, strict=True)]) > 0.999


def test_statistics_are_finite():
    for _, t in data():
        x = quality.statistics(t)
        assert len(x) == len(quality.NAMES) and np.isfinite(x).all()


def test_pooling_rises_and_keeps_the_mean():
    r = np.random.default_rng(2)
    s, w, m = np.arange(50.0), r.integers(1, 9, 50).astype(float), r.random(50)
    edges, values = quality.pool(s, w, m)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(edges) >= 0).all()
    assert np.average(np.interp(s, edges, values), weights=w) == pytest.approx(np.average(m, weights=w))


def _dedup(docs):
    """Line dedup by hand: {doc_id: text}."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for k, t in docs.items():
        for line in t.split("\n"):
            where[key(line)].add(k)
    gone = lambda k, x: len(x) >= 10 and len(where[x]) >= 2 and k != min(where[x])
    return {k: "\n".join(line for line in t.split("\n") if not gone(k, key(line))) for k, t in docs.items()}


def _mix(docs, source):
    """Copies by hand, from sorted hashes."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in docs.items()}
    total = Counter()
    for k in docs:
        total[source[k]] += size[k]
    names = sorted(total)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3 * total[s]
            left -= goal[s]
        open_ -= over
    copies = {}
    for s in names:
        own = sorted((int(hashlib.md5(str(k).encode()).hexdigest()[:9], 16), k) for k in docs if source[k] == s)
        passes = min(int(goal[s] // total[s]), 3) if total[s] else 1
        copies |= dict.fromkeys((k for _, k in own), passes)
        rest, largest, at = (goal[s] - passes * total[s], float("inf"), 0) if total[s] and passes < 3 else (0, 0, len(own))
        for _ in range(4):  # each round goes on from where the one before stopped, with documents that the rest has room for
            while at < len(own):
                k = own[at][1]
                if size[k] <= largest:
                    if size[k] > rest:
                        break
                    copies[k] += 1
                    rest -= size[k]
                at += 1
            largest = int(rest)
            if rest < 1:
                break
    return copies


@pytest.fixture(scope="module")
def ran(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_pipeline_against_brute_force(spark, scored, ran):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = _dedup({k: r.text for k, r in docs.items() if scored[k].predicted})
    groups = simhash.brute_force(list(texts.items()))
    texts = {k: t for k, t in texts.items() if groups[k][1] == k}
    copies = _mix(texts, {k: docs[k].source for k in texts})
    assert Counter(r.doc_id for r in ran) == Counter({k: n for k, n in copies.items() if n})
    library = Tokenizer.from_file(Q.tokenizer_path())
    library.no_truncation()
    seen = {}
    for r in ran:
        if r.doc_id not in seen:
            seen[r.doc_id] = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.token_ids) == seen[r.doc_id] and r.n_tokens == len(r.token_ids)
        assert (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)


def test_stages_keep_the_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == odd.columns
    assert "n_tokens" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
