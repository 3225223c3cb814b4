"""Operators that read each text once: encoding, language, quality, decontamination, line rules."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revsieve.llm import bpe, decontaminate, language, line_rules, ranking_quality
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_encoding_equals_the_library(spark, odd, docs):
    library = Tokenizer.from_file(bpe.default_path())
    extra = ["Hello  World's café <|endoftext|>x<|startoftext|>", "ÀΣΊΣ 123½²", "漢字 \u0085\x1c'll 'LL it's‍👍🏽", "aaaaaaaaaaa!!!!!!!", "İstanbul ﬁ é Ꟍ \U000107bb", "<| <|endoftext |>"]
    texts = spark.createDataFrame([(x,) for x in extra], "text string")
    for df in (docs.select("text"), odd.select("text", "ids"), texts):
        for r in bpe.encode_decode(df, bpe.default_path()).collect():
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_every_token_reaches_itself_or_is_left_out():
    v = bpe.Vocabulary(bpe.default_path())
    encoder = bpe.Encoder(v)
    for token, text in list(v.token.items())[512:6000:37]:
        if text.endswith(v.suffix) and text not in v.special:
            got = encoder.word(text.removesuffix(v.suffix))
            assert got == [token] or token not in v._reachable()


def test_encoding_of_an_empty_table(empty):
    assert bpe.encode_decode(empty, bpe.default_path()).count() == 0


def test_languages_are_found_on_held_out_documents(spark, docs, odd, empty):
    rows = language.op9_marginal_unigrams(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows) > 10
    assert all(0 <= r.score <= 1 for r in rows)
    got = language.identified(odd, docs, language.default_path(), label="lang").collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in r.text or ""))
    assert language.identified(empty, docs, language.default_path()).count() == 0
    none = language.identified(odd, empty, language.default_path()).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_forward_pass_sums_all_segmentations():
    import numpy as np

    names = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    chances = np.array([[0.3, 0.1], [0.1, 0.2], [0.2, 0.2], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1], [0.1, 0.1]])
    s = language.Segmenter(names, chances)
    table = dict(zip(names, chances.tolist()))

    def total(text, k):
        return 1.0 if not text else sum(table[p][k] * total(text[len(p):], k) for p in names if text.startswith(p))

    for word in ("a", "abab", "bbaab", "abaaba"):
        for k in range(2):
            assert abs(np.exp(s.log_sum(word)[k]) - total("▁" + word, k)) < 1e-12
            assert abs(s.forward("▁" + word)[0][-1][k] - total("▁" + word, k)) < 1e-12
            assert abs(sum(len(n) * u for n, u in s.expected(word, k)) - len(word) - 1) < 1e-9


def test_sums_of_long_words_are_whole():
    """Words of 160 letters and more against plain recursions in logarithms, letters outside the vocabulary among them."""
    rng = np.random.default_rng(4)
    names = ["a", "b", "▁", "ab", "ba", "aab", "bbab", "▁a", "abababab"]
    chances = rng.random((len(names), 2)) * 1e-4
    s = language.Segmenter(names, chances)
    for size in (39, 40, 41, 160, 1000, 9000):
        word = "".join("abc"[i] for i in rng.choice(3, size, p=[0.6, 0.35, 0.05]))
        text = "▁" + word
        for k in range(2):
            logs, count = [0.0], [[0.0, 0.0]]
            for end in range(1, len(text) + 1):
                here = [(np.log(chances[i, k]), n) for i, n in enumerate(names) if text.endswith(n, 0, end)]
                if not any(len(n) == 1 for _, n in here):
                    here.append((np.log(language.RARE), text[end - 1]))
                each = [(logs[end - len(n)] + p, n) for p, n in here]
                logs.append(np.logaddexp.reduce([x for x, _ in each]))
                # uses of "ab" and of "a" over all segmentations of the prefix
                count.append([sum(np.exp(x - logs[-1]) * (count[end - len(n)][j] + (n == ("ab", "a")[j])) for x, n in each) for j in range(2)])
            assert abs(s.log_sum(word)[k] - logs[-1]) < 1e-9 * size
            uses = Counter()
            for name, n in s.expected(word, k):
                uses[name] += n
            assert np.allclose([uses["ab"], uses["a"]], count[-1], rtol=1e-8)


def test_quality_on_held_out_labels(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = ranking_quality.op5_bradley_terry(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 50
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    small = spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(
        spark.createDataFrame([(None, 1, 0), (10**9, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    rows = ranking_quality.ranked(odd, docs, small).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1
    assert {r.score for r in ranking_quality.ranked(odd, docs, small.where("quality = 1")).collect()} == {ranking_quality.CUT}
    assert ranking_quality.ranked(empty, docs, small).count() == 0


def test_quality_learns_from_every_label(spark, monkeypatch):
    """All labelled rows are fitted, in several groups, and the cut is the quantile of them all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = ranking_quality.training_rows(docs, labels, "text", "doc_id", "quality").collect()
    assert {r.doc for r in rows} == {r.doc_id for r in labels.where("quality IS NOT NULL").join(docs, "doc_id").collect()}
    found = ranking_quality.fitted(docs, labels, "text", "doc_id", "quality", 8, group=100)
    x = np.array([r.measures for r in rows])
    assert np.allclose(found.middle, x.mean(axis=0)) and np.allclose(found.spread, x.std(axis=0) + 1e-9)
    assert abs(found.cut - np.quantile(found.strengths(x), np.mean([not r.good for r in rows]))) < 1e-9
    values = [*np.random.default_rng(1).normal(size=3000), *[0.5] * 2000, -1e6, 1e6]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.3, 0.4321, 0.7, 1.0):
        assert abs(ranking_quality.quantile(df, q, few=20) - np.quantile(values, q)) < 1e-9


def held(text, item, k):
    doc, own = decontaminate.words_of(text), decontaminate.words_of(item)
    if 0 < len(own) < k:
        k = len(own) if len(b"".join(own).decode()) >= decontaminate.LEAST_CHARS else k
    own = decontaminate.runs(own, k)
    return len(own), len(own & decontaminate.runs(doc, k))


def test_leaks_equal_brute_force(spark, odd, empty):
    rows = odd.collect()
    long = max((r.text or "" for r in rows), key=len).split(" ")
    items = [(1, " ".join(long[20_000:20_040])), (2, " ".join(long[5:11])), (3, "too short"), (4, None), (None, " ".join(long[300:700])), (5, "not in any of these documents at all"),
             (8, " ".join(long[70:74])), (9, " ".join(long[80:82])), (9, "no"), (6, " ".join(long[900:930]).upper() + "!"), (6, " ".join(long[50:60] + ["other"] * 30)), (7, rows[4].text)]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, leaks string")
    for block in (8_000_000, 700):
        got = Counter((r.text, x.item_id, x.shingles, x.found) for r in decontaminate.with_leaks(odd, table, block_bytes=block).collect() for x in r.leaks)
        want = Counter()
        for r in rows:
            for i, t in items:
                n, m = held(r.text, t, 5)
                if n and m >= 0.8 * n:
                    want[r.text, i, n, m] += 1
        assert got == want and want
    clean = decontaminate.without_leaks(odd, table)
    assert clean.columns == odd.columns and clean.count() == odd.count() - len({id(r) for r in rows if any(k[0] == r.text for k in want)})
    assert decontaminate.without_leaks(empty, table).count() == 0
    assert decontaminate.without_leaks(odd, table.limit(0)).count() == odd.count()


def test_short_items_and_items_without_blanks_are_found(spark):
    rng = np.random.default_rng(3)
    body = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 300))
    chinese = "".join(chr(0x4E00 + i) for i in rng.integers(0, 3000, 200))
    docs = spark.createDataFrame([(1, body + " Capital of Mongolia? " + body), (2, chinese), (3, body), (4, "mongolia of capital")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital of mongolia"), (2, chinese[60:90]), (3, chinese[10:15]), (4, chinese[20:23]), (5, chinese[::-1][:30])], "item_id long, text string")
    got = {(r.doc_id, x.item_id) for r in decontaminate.with_leaks(docs, items).collect() for x in r.leaks}
    assert got == {(1, 1), (2, 2), (2, 3)}
    found = duckdb.connect()
    found.register("documents", docs.toPandas())
    found.register("benchmark", items.toPandas())
    assert {r[:2] for r in found.execute(decontaminate.OP6_SQL).fetchall()} == got


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(3)}
    lines, earlier = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def plain_rules(rows, least, share, left):
    keys = lambda t: {line_rules.line_key(x.encode().split()) for x in (t or "").split("\n") if x.encode().split()}
    texts, first = defaultdict(set), {}
    hosts = defaultdict(set)
    for doc, text, host in rows:
        hosts[host].add((doc, text or ""))
        for k in keys(text):
            texts[host, k].add((doc, text))
            first[host, k] = min(first.get((host, k), (float("inf"), "")), (float("-inf") if doc is None else doc, text))
    out = []
    for doc, text, host in rows:
        gone = {k for k in keys(text) if len(texts[host, k]) > max(least, share * len(hosts[host])) and first[host, k][1] != text}
        n = base(text)
        removed = sum(len(x.encode().split()) for x in (text or "").split("\n") if x.encode().split() and line_rules.line_key(x.encode().split()) in gone)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        out.append((doc, *n, removed, failed, not failed and n[0] - removed >= left * n[0]))
    return out


def test_line_rules_equal_brute_force(spark, odd, docs, empty):
    for df, least in ((odd, 1), (docs, 2), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 3)):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = line_rules.verdicts(df, least=least, share=0.0).select("doc_id", *line_rules.MEASURES, "n_words_removed", "base_failed", "kept").collect()
        assert Counter(map(tuple, got)) == Counter(plain_rules(rows, least, 0.0, line_rules.LEFT))
    kept = line_rules.apply_rules(docs, least=2, share=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in plain_rules([(r.doc_id, r.text, r.source) for r in docs.collect()], 2, 0.0, line_rules.LEFT))
    assert line_rules.apply_rules(empty).count() == 0 and line_rules.apply_rules(odd).columns == odd.columns


def test_removed_lines_leave_the_text(spark):
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6))
    df = spark.createDataFrame([(i, body(i) + "\nAll Rights  reserved 2024", "h") for i in range(30)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_rules.apply_rules(df).collect()}
    assert len(got) == 30 and got[0].endswith("2024") and all(got[i] == body(i) for i in range(1, 30))


def test_one_broadcast_or_join_gives_equal_rows(docs, monkeypatch):
    first = sorted(map(tuple, line_rules.apply_rules(docs, least=2, share=0.0).collect()))
    monkeypatch.setattr(line_rules, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, line_rules.apply_rules(docs, least=2, share=0.0).collect())) == first
    assert F is not None
