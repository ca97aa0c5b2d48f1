"""The pipeline's stages on a small table, each held against what its operator decides."""

import corpus_pipeline
import pytest

from tokenloom.llm import line_dedup, ngram_join, quality
from tokenloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        docs = out[-1][1]
    return [(a.collect(), b.collect(), a, b) for a, b in out]


def test_columns_and_decisions(stages):
    columns = stages[0][2].columns
    assert all(b.columns == columns for *_, b in stages[:-1])
    rules, lines, join, leaks, packed = stages
    kept = {x["doc_id"] for x in quality.judged(rules[2]).where("kept").collect()}
    assert {x["doc_id"] for x in rules[1]} == kept and 0 < len(kept) < len(rules[0])
    cut = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(lines[2]).collect()}
    assert {x["doc_id"]: x["text"] for x in lines[1]} == cut
    assert all(x["n_chars"] == len(x["text"]) for x in lines[1])
    heads = {x["component_id"] for x in ngram_join.jaccard_classes(join[2]).collect()}
    assert {x["doc_id"] for x in join[1]} == heads
    items = [x["text"] for x in table(stages[0][2].sparkSession, SF, "benchmark").collect()]
    gone = {x["doc_id"] for x in leaks[0] if any(i in x["text"] for i in items)}
    assert {x["doc_id"] for x in leaks[1]} == {x["doc_id"] for x in leaks[0]} - gone
    assert {x["doc_id"] for x in packed[1]} == {x["doc_id"] for x in leaks[1]}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1][1])


def test_stages_take_odd_tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).toPandas()
    names = "doc_id long, text string, lang string, source string, N_LINES int, n_words string, row int, Kept boolean, label string"
    rows = [(int(x.doc_id), x.text, x.lang, x.source, 7, "w", 1, False, None) for x in base.itertuples()]
    rows += [rows[0], (None, rows[1][1] + " more", None, None, None, None, None, None, None), (5000, None, *[None] * 7), (5001, "", *[None] * 7), (5002, "word " * 50_000, *[None] * 7)]
    for table_rows in (rows, []):
        docs = spark.createDataFrame(table_rows, names)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(x["N_LINES"] in (7, None) and x["n_words"] in ("w", None) for x in got)
            if stage is not corpus_pipeline.quality_rules:
                assert len(got) <= len(table_rows)
        assert (corpus_pipeline.best_fit_packing(spark, docs, SF).count() > 0) == bool(table_rows)


def plain_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    at = {}
    for d, t in rows.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                at.setdefault(key(x), set()).add(d)
    return {d: "\n".join(x for x in t.split("\n") if len(at.get(key(x), ())) < 5 or max(at[key(x)]) == d) for d, t in rows.items()}


def plain_one_of_each(rows):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = {d: shingles(t) for d, t in rows.items()}, {d: d for d in rows}

    def top(d):
        return d if up[d] == d else top(up[d])

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: t for d, t in rows.items() if top(d) == d}


def test_planted_cases_through_all_stages(spark):
    """Garbage, repeated lines, copies, leaks with edits and a long text among clean documents, against plain versions of each stage."""
    import random

    from tokenizers import Tokenizer

    r = random.Random(31)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [x for x in docs.where("lang = 'en' and length(text) > 300").collect()]
    body = lambda i: clean[i].text[:900]
    words = lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(3, 9))) for _ in range(150))
    item = table(spark, SF, "benchmark").where("length(text) > 150").orderBy("item_id").first().text
    edited = "".join("q" if n % 60 == 59 else c for n, c in enumerate(item)).replace(" ", "  ")
    line = "This site uses cookies to give its readers the best experience of all."
    rows = {90_000 + i: words() for i in range(3)}
    rows |= {91_000 + i: f"{line.upper() if i % 2 else line}\n{body(i)}" for i in range(6)}
    near = body(8).split()
    rows |= {92_000 + i: " ".join(near[:60] + [f"w{i}"] + near[61:]) for i in range(4)}
    rows |= {93_000: f"{body(9)} {edited} {body(10)}", 93_001: f"{body(11)} {item}", 94_000: " ".join(x.text for x in clean[:40])}
    own = {c: None for c in docs.columns}
    planted = [tuple({**own, "doc_id": d, "text": t, "lang": "en"}[c] for c in docs.columns) for d, t in rows.items()]
    now = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    texts = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        out.append(now)
    judged, lines, single, free = (texts(x) for x in out[:4])
    assert not {d for d in judged if d // 1000 == 90} and set(rows) - {90_000, 90_001, 90_002} <= set(judged)
    assert lines == plain_dedup(judged) and lines != judged and line.upper() in lines[91_005] and line not in lines[91_004]
    assert single == plain_one_of_each(lines) and not {92_001, 92_002, 92_003} & set(single)
    items = [x["text"] for x in table(spark, SF, "benchmark").collect()]
    held = {d for d, t in single.items() if any(i in t for i in items)} | ({93_000} & set(single))
    assert 93_000 in single and set(free) == set(single) - held
    lib = Tokenizer.from_file(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    packed = {}
    for x in out[4].collect():
        packed[x["doc_id"]] = packed.get(x["doc_id"], 0) + x["length"]
    assert packed == {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in free.items()}
