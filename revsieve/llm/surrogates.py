"""Keyed, type-consistent surrogates for personal data, with collision checks.

One pattern finds e-mail addresses, secrets, account and card numbers, telephone numbers, internet addresses and names
of persons (a title or a common given name before capitalised words). Each distinct entity of the table gets one
surrogate of its kind, drawn from SHA-256 of key, kind, entity and attempt: equal entities get equal surrogates in
every document, whatever their notation. Surrogates keep the format: number and grouping of digits, country code and
first card digit, whether a check digit is valid, private addresses, upper case, letters and digits of a
mailbox; names keep title, gender and script.

Collision check: a surrogate that two entities drew, or that is itself an entity found in the table, is drawn again by
all but the first (least attempt, then least entity) until none is left; those already placed never move.

Native: expressions, joins and windows only. Texts without entities pass by untouched and are not shuffled; the others
meet their surrogates by a digest of the text, so that copies share the work. Entities are made distinct within a text and
before each shuffle; a very common entity is one row of the surrogate table, and the join on it can be split.

Defined cases: a null text stays null; empty texts and texts without entities are unchanged; repeated rows get equal texts; an
empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revsieve.llm.common import columns, documents, fresh
from revsieve.plans.lineage import new_dir

KEY = "change me"  # of the named query; a real run passes its own

#: Common given names and titles by gender and script, and syllables of invented family names.
MALE = {
    "latin": "James John Robert Michael David Thomas Peter Paul Daniel Martin Hans Karl Klaus Stefan Jean Pierre Michel Antoine José Juan Carlos Luis".split(),
    "cyrillic": "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел".split(),
    "greek": "Γιώργος Νίκος Γιάννης Δημήτρης Κώστας Παύλος".split(),
}
FEMALE = {
    "latin": "Mary Anna Linda Susan Sarah Karen Julia Laura Emma Helen Ursula Monika Petra Sabine Marie Claire Sophie Camille María Carmen Lucía Elena".split(),
    "cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Δέσποινα".split(),
}
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Don", "Г-н", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "Г-жа", "Κυρία"]
SYLLABLES = {
    "latin": "ba be bo da del den do fa fel ga gen ha hol ka ker la lin lo ma mer mo na nor ra ren ro sa sel ta tor va vel".split(),
    "cyrillic": "ба ве го да жен зо ка ле ми но па ре со та фе хо".split(),
    "greek": "βα γε δο ζα θε κα λο μα νε πα ρο σα τε φι χο ψα".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GIVEN = "|".join(n for names in (*MALE.values(), *FEMALE.values()) for n in names)
_TITLE = "|".join([*MALE_TITLES, *FEMALE_TITLES])
_NAME = r"\p{Lu}[\p{Ll}\p{M}]++(?:[-'’]\p{Lu}?[\p{Ll}\p{M}]++)?"
#: In the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _title(c: Column) -> Column:
    return F.regexp_extract(c, rf"^((?:{_TITLE})\.? )", 1)


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(c: Column) -> Column:
    male, female = ("|".join(n for names in x.values() for n in names) for x in (MALE, FEMALE))
    return (
        F.when(c.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\b|^(?:{female}) "), "f")
        .when(c.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\b|^(?:{male}) "), "m").otherwise("m")
    )


def _kind(c: Column) -> Column:
    out = F.when(c.rlike(f"^(?:{KINDS['email']})$"), "email")
    for name in list(KINDS)[1:-1]:
        out = out.when(c.rlike(f"^(?:{KINDS[name]})$"), name)
    return out.otherwise(F.concat(F.lit("person:"), _gender(c), F.lit(":"), _script(c)))


def _canonical(kind: Column, c: Column) -> Column:
    """The entity without its notation."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), _digits(c))
        .when(kind == "iban", F.regexp_replace(c, " ", ""))
        .when(kind == "ip", c)
        .when(kind.isin("email", "secret"), F.lower(c))
        .otherwise(F.lower(F.substring(c, F.length(_title(c)) + 1, F.length(c))))
    )


def entity(mention: Column) -> Column:
    kind = _kind(mention)
    return F.struct(kind.alias("kind"), _canonical(kind, mention).alias("canonical"))


# -- drawing --------------------------------------------------------------------------


def _luhn(number: Column) -> Column:
    """Sum of a number's digits as its last check digit counts them, modulo ten."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    counted = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(counted, F.lit(0), lambda a, d: a + d), F.lit(10))


def _pick(hexes: Column, at: int, options: list[str]) -> Column:
    number = F.conv(F.substring(hexes, at, 6), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(number, F.lit(len(options))) + 1)


def _syllable_of(seed: Column, syllables: list[str]):
    return lambda i: _pick(F.sha2(F.concat(seed, i.cast("string")).cast("binary"), 256), 7, syllables)


def _masked(word: Column, hexes: Column) -> Column:
    """Letters for letters and digits for digits; other characters stay."""
    def one(ch, i):
        value = F.conv(F.substring(hexes, F.pmod(2 * i, F.lit(124)) + 1, F.lit(3)), 16, 10).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(value, F.lit(26)) + 1, F.lit(1))
        return F.when(ch.rlike(r"\p{L}"), letter).when(ch.rlike(r"\p{N}"), F.pmod(value, F.lit(10)).cast("string")).otherwise(ch)

    return F.array_join(F.transform(F.split(word, ""), one), "")


def drawn(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of an entity."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canonical, attempt.cast("string"))
    first = F.sha2(seed.cast("binary"), 256)
    hexes = F.concat(first, F.sha2(F.concat(seed, F.lit("\u0001+")).cast("binary"), 256))
    numbers = F.translate(hexes, "abcdef", "012345")
    size = F.length(canonical)
    fill = lambda start: F.substring(numbers, F.lit(1), size - start)
    body = F.concat(F.substring(canonical, 1, 1), F.substring(numbers, F.lit(1), size - 2))
    # the check digit completes the sum to ten if it did before, else misses it by 1 to 9
    off = F.when(_luhn(canonical) == 0, 0).otherwise(F.pmod(F.conv(F.substring(hexes, 100, 4), 16, 10).cast("int"), F.lit(9)) + 1)
    check = F.pmod(F.lit(20) - _luhn(F.concat(body, F.lit("0"))) + off, F.lit(10))
    octet = lambda i: (F.pmod(F.conv(F.substring(hexes, i, 4), 16, 10).cast("int"), F.lit(223)) + 1).cast("string")
    private = canonical.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    ending = F.regexp_extract(domain, r"\.(com|net|org)$", 1)
    address = F.concat(
        _masked(local, hexes), F.lit("@"), _masked(F.substring_index(domain, ".", 1), F.reverse(hexes)), F.lit(".example."),
        F.when(ending == "", "org").otherwise(ending))
    long_hex = F.substring(F.concat(hexes, F.sha2(F.concat(seed, F.lit("\u0001!")).cast("binary"), 256)), F.lit(1), size)
    secret = F.when(canonical.startswith("akia"), F.concat(F.lit("akia"), F.substring(hexes, 1, 16))).otherwise(long_hex)
    out = (
        F.when(kind == "email", address)
        .when(kind == "secret", secret)
        .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), fill(2)))
        .when(kind == "phone", F.concat(F.substring(canonical, 1, 1), fill(1)))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ssn", fill(0))
        .when(kind == "ip", F.concat_ws(".", F.when(private, "10").otherwise(octet(1)), octet(5), octet(9), octet(13)))
    )
    for script, syllables in SYLLABLES.items():
        more = F.transform(F.sequence(F.lit(1), attempt), _syllable_of(seed, syllables))
        family = F.concat(*(_pick(hexes, at, syllables) for at in (20, 30, 40)), F.when(attempt > 0, F.array_join(more, "")).otherwise(""))
        for gender, names in (("m", MALE), ("f", FEMALE)):
            given = F.when(canonical.contains(" "), F.concat(F.lower(_pick(hexes, 10, names[script])), F.lit(" "))).otherwise("")
            out = out.when(kind == f"person:{gender}:{script}", F.concat(given, family))
    return out


def rendered(mention: Column, kind: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the notation of one mention."""
    def step(acc, ch):
        used = ch.rlike(r"[0-9]") | (kind.isin("iban") & (ch != " "))
        return F.struct(
            F.concat(acc["text"], F.when(used, F.substring(surrogate, acc["at"], F.lit(1))).otherwise(ch)).alias("text"),
            (acc["at"] + F.when(used, 1).otherwise(0)).alias("at"))

    spread = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), step)["text"]
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spread)
        .when(kind == "ip", surrogate)
        .when(kind.isin("email", "secret"), F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .otherwise(F.concat(_title(mention), F.initcap(surrogate)))
    )


# -- the surrogate table --------------------------------------------------------------


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = new_dir(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical); no two surrogates of a kind are equal, none is an entity."""
    spark = entities.sparkSession
    column = {c: F.col(c) for c in ("kind", "canonical", "attempt")}
    state = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    originals = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        state = written(spark, state.select("kind", "canonical", "attempt", drawn(**column, key=key).alias("surrogate")), "surrogates")
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical")
        checked = state.join(originals, ["kind", "surrogate"], "left").withColumn(
            "again", F.col("real").isNotNull() | (F.row_number().over(order) > 1))
        if checked.where("again").isEmpty():
            return state.select("kind", "canonical", "surrogate")
        state = checked.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def with_surrogates(df: DataFrame, key: str, text: str = "text", entities: str | None = None) -> DataFrame:
    """The table with entities in its texts replaced; ``entities`` names a column to add: the surrogates in text order."""
    spark, t = df.sparkSession, F.col(f"`{text}`")
    found, digest, given = fresh(df, "_found", "_digest", "_given")
    seen = df.withColumn(found, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    some = F.coalesce(F.size(found), F.lit(0)) > 0
    marked = seen.where(some).withColumn(digest, F.sha2(t.cast("binary"), 256))
    held = marked.select(F.col(digest).alias("digest"), F.explode(F.array_distinct(F.transform(found, entity))).alias("e"))
    held = written(spark, held.select("digest", "e.kind", "e.canonical").distinct(), "entities")
    table = surrogate_table(written(spark, held.select("kind", "canonical").distinct(), "kinds"), key)
    of_text = held.join(table, ["kind", "canonical"]).groupBy("digest").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "canonical"), "surrogate"))).alias(given))
    joined = marked.join(of_text.withColumnRenamed("digest", digest), digest)
    replaced = F.transform(found, lambda m: rendered(m, entity(m)["kind"], F.element_at(F.col(given), entity(m))))
    between = F.split(t, PATTERN, -1)
    pairs = F.zip_with(between, replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))

    def out(rows: DataFrame, new_text: Column, surrogates: Column) -> DataFrame:
        by_name = {n: c for n, c in zip(df.columns, columns(df))}
        by_name[text] = new_text.alias(text)
        chosen = [c for n, c in by_name.items() if n != entities]
        return rows.select(*chosen, *([surrogates.alias(entities)] if entities else []))

    plain = out(seen.where(~some), t, F.array().cast("array<string>"))
    return plain.unionByName(out(joined, F.array_join(pairs, ""), replaced))


def op2_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = with_surrogates(docs, KEY, entities="surrogates")
    return out.select("doc_id", "text", F.size("surrogates").cast("bigint").alias("n_entities"))
