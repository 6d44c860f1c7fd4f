"""All stages of the pipeline, one after the other, against plain versions on planted documents."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm.tables import keep
from riskloom.llm.tokens import tokenizer_path
from test_quality import plain as base_counts
from test_simhash import plain_print

ASCII = dict(zip(range(65, 91), range(97, 123)))


def made():
    """(doc_id, text): clean texts, and of each planted kind some."""
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [prose(30), prose(14), prose(4)]
    passage = prose(60)
    texts = {i: prose(rng.randint(70, 160)) for i in range(30)}  # clean
    texts |= {40: prose(20), 41: "again and again " * 60, 42: "", 43: None}  # base rules
    noise = "".join(map(chr, range(33, 127)))
    texts |= {44: " ".join("".join(rng.choices(noise, k=7)) for _ in range(300))}  # bands
    texts |= {50: texts[3], 51: texts[3].upper(), 52: texts[4] + " once"}  # copies
    texts |= {i: f"{prose(40)} {passage} {prose(40)}" for i in range(60, 64)}  # a shared passage
    texts |= {70: f"{prose(60)} {items[0].upper()} {prose(20)}", 71: f"{prose(70)} {items[1]}",
              72: f"{prose(60)}, {items[2]}; {prose(9)}"}  # benchmark text
    return texts, items


def near(rows):
    """Smallest id of each component of fingerprints within two bits."""
    prints = [(i, plain_print(t)) for i, t in rows]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in prints:
        for j, q in prints:
            if i < j and (p ^ q).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, t) for i, t in rows if find(i) == i}


def without_repeats(rows, window=35):
    starts = Counter()
    cut = {i: (t or "").encode().split() for i, t in rows}
    for w in cut.values():
        starts.update(tuple(w[k:k + window]) for k in range(len(w) - window + 1))
    out = set()
    for i, t in rows:
        w, gone = cut[i], set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        if not gone:
            out.add((i, t))
        elif left:
            out.add((i, b" ".join(left).decode()))
    return out


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII)) if w]


def clean_of(rows, items, window=10):
    known = set()
    for w in map(tokens, items):
        size = min(window, len(w))
        known.update(tuple(w[k:k + size]) for k in range(len(w) - size + 1) if w)
    sizes = {len(k) for k in known}
    return {(i, t) for i, t in rows if not any(
        tuple(tokens(t)[k:k + n]) in known for n in sizes for k in range(len(tokens(t)) - n + 1))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, items = made()
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage(spark, folder):
    texts, items = made()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "substring dedup", "benchmark decontamination",
        "packing"]
    rows = set(texts.items())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, folder))
        assert docs.columns == columns
        found = docs.collect()
        got = {(r.doc_id, r.text) for r in found}
        assert len(found) == len(got) and all(r.n_chars == len(r.text) for r in found)
        if name == "quality rules":  # the bands' own test is test_quality
            assert got == {(i, t) for i, t in rows if not base_counts(t)[-1] and i != 44}
        elif name == "simhash near-dedup":
            assert got == near(sorted(rows)) and not {50, 51} & {i for i, _ in got}
        elif name == "substring dedup":
            assert got == without_repeats(sorted(rows))
            assert {i for i, _ in got - rows} == {60, 61, 62, 63}
        else:
            assert got == clean_of(rows, items) and not {70, 71, 72} & {i for i, _ in got}
        rows = got
    assert {i for i in range(30)} <= {i for i, _ in rows}  # clean documents are all there
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == {i for i, _ in rows}
    for i, t in rows:
        ids = coder.encode(t, add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            part = ids[p.start:p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p.length
        assert at == len(ids)


def test_run_is_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, folder))
    place = ("sequence_id", "offset")  # where a piece lies depends on the partitions
    shown = [c for c in docs.columns if c not in place]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).select(shown).collect())) == Counter(
        map(tuple, docs.select(shown).collect()))
