"""Sharding and surrogates: the operators without Python on the executors."""

import math
import re
import zlib
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from revsieve.llm import sharding, surrogates


def best_shard(key, weights):
    text = "null key" if key is None else str(key)

    def score(s):
        bits = int(md5(f"{text}/{s}".encode()).hexdigest()[:13], 16)
        return -weights[s] / math.log((bits + 0.5) / 2**52), -s

    return max(range(len(weights)), key=score)


def test_shards_equal_brute_force(odd):
    got = sharding.shard_table(odd, "doc_id", "text", [1.0] * 8).collect()
    rows = odd.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.key, r["size"], r.text_crc32) for r in got) == want
    for r in got:
        assert r.shard == best_shard(r.key, [1.0] * 8) and r.grown_shard == best_shard(r.key, [1.0] * 9)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_weights_share_the_keys(spark):
    keys = spark.range(20_000)
    n = {r.shard: r["count"] for r in sharding.place(keys, "id", [1.0, 3.0, 4.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / n[0] - 3) < 0.4 and abs(n[2] / n[0] - 4) < 0.5
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [1.0, 0.0])


def test_repeated_row_fills_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    df = spark.range(50).select(F.lit(9).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_table(df, "doc_id", "text", [1.0] * 8).collect()
    assert sorted(r.slot for r in got) == list(range(50))


def test_native_plans(odd, empty):
    for df in (sharding.shard_table(odd, "doc_id", "text", [1.0] * 8), surrogates.with_surrogates(odd, "k")):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert sharding.shard_table(empty, "doc_id", "text", [1.0] * 8).count() == 0
    assert surrogates.with_surrogates(empty, "k").count() == 0


TEXTS = [
    "Call +1 (017) 555-7713 or JOHN.34@MAIL7.EXAMPLE.COM! Mrs. Maria Klein met Herr Klaus Weber at 10.2.3.4.",
    "card 4111 1111 1111 1111 and 4111111111111111, john.34@mail7.example.com; Г-жа Анна Петрова",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 129.38.82.176. 7536784127813050 4845168114407329 Анна Петрова',
    "Nothing here: v1.2.3, 12 of 2024-01-05, x = 3.14 and 10,000 more.", "", None,
]


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = surrogates.with_surrogates(df, key, entities="surrogates").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.surrogates for r in rows]


def test_surrogates_keep_type_format_and_coreference(spark):
    got, names = replaced(spark, TEXTS)
    assert got[3:] == TEXTS[3:] and names[3:] == [[], [], []]
    for secret in ("7713", "JOHN", "john.34", "Klein", "Weber", "10.2.3.4", "4111", "04dbebab", "129.38", "7536784127813050", "Петрова"):
        assert not any(secret in (t or "") for t in got)
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or [A-Z]{4}\.\d\d@[A-Z]{4}\d\.EXAMPLE\.COM! Mrs\. \w+ \w+ met Herr \w+ \w+ at 10\.\d+\.\d+\.\d+\.", got[0])
    mail = re.search(r"\S+@\S+\.COM", got[0])[0]
    assert mail.lower() in got[1]
    spaced, plain = re.search(r"card ((?:\d{4} ){3}\d{4}) and (\d{16})", got[1]).groups()
    assert spaced.replace(" ", "") == plain and plain[0] == "4"
    digits = [int(d) for d in reversed(plain)]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    first = re.search(r"Mrs\. (\w+)", got[0])[1]
    assert first in surrogates.FEMALE["latin"]
    russian = re.search(r"Г-жа ([А-Яа-яё]+ [А-Яа-яё]+)", got[1])[1]
    assert russian in got[2] and russian.split()[0] in surrogates.FEMALE["cyrillic"]
    assert replaced(spark, TEXTS)[0] == got and replaced(spark, TEXTS, "other")[0] != got


def test_surrogates_stay_distinct(spark):
    people = [f"Mr. {a}{b}" for a in ("Ka", "Mo", "Te", "Bo") for b in ("lin", "ren", "dor", "bek", "lar")]
    texts = [f"{p} from 12{i:02d}-55-1234x and 10.0.{i}.{j}" for i, p in enumerate(people) for j in range(20)]
    got, names = replaced(spark, texts)
    originals = {m for t in texts for m in re.findall(r"10\.0\.\d+\.\d+|Mr\. \w+", t)}
    drawn = {m for t in got for m in re.findall(r"10\.\d+\.\d+\.\d+|Mr\. \w+", t)}
    assert len(drawn) == len(originals) and not drawn & originals


def test_collisions_are_drawn_again(spark, monkeypatch):
    plain = surrogates.drawn
    monkeypatch.setattr(surrogates, "drawn", lambda kind, canonical, attempt, key: F.when(
        attempt < 3, F.concat(F.lit("s"), attempt.cast("string"))).otherwise(plain(kind, canonical, attempt, key)))
    entities = spark.createDataFrame([("secret", c * 32) for c in "abcdef"] + [("secret", "s1")], "kind string, canonical string")
    got = surrogates.surrogate_table(entities, "k").collect()
    assert len({r.surrogate for r in got}) == 7 and not {r.surrogate for r in got} & {r.canonical for r in got}
    assert {"s0", "s2"} <= {r.surrogate for r in got}


def test_surrogates_on_odd_rows(odd):
    got = Counter(map(tuple, surrogates.with_surrogates(odd, "k").collect()))
    assert got == Counter(map(tuple, odd.collect()))  # no entities in it: nothing changes
