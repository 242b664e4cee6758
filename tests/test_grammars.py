import pytest
from pyspark.sql import functions as F

from glyphloom.errors import ArgumentError
from glyphloom.functions import native as N
from glyphloom.grammars import case, chat, dates, g2p, keypad, numbers, plurals, tagger, weather
from glyphloom.operators import morphology as Mo


def one(spark, expression, *values):
    return [r.o for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string").withColumn("o", expression(F.col("s"))).orderBy("k").collect()]


def test_numbers(spark):
    n = {1: "one", 19: "nineteen", 20: "twenty", 342: "three hundred forty two", 1000: "one thousand", 90_017: "ninety thousand seventeen", 7_000_001: "seven million one", 9_999_999: "nine million nine hundred ninety nine thousand nine hundred ninety nine", 0: None, 10_000_000: None}
    assert one(spark, lambda c: numbers.number_name(c.cast("long")), *map(str, n)) == list(n.values())


def test_plurals_and_weather(spark):
    words = {"cat": "cats", "bus": "buses", "city": "cities", "boy": "boys", "foot": "feet", "wolf": "wolves", "church": "churches", "sheep": "sheep", "analysis": "analyses", "axis": "axes", "photo": "photos", "mouse": "mice", "wife": "wives", "puppy": "puppies", "house": "houses", "lunch": "lunches", "deer": "deer", "criterion": "criteria"}
    assert one(spark, plurals.plural, *words) == list(words.values())
    assert one(spark, lambda c: plurals.plural(c, {"cat": "kitties"}), "cat", "dog") == ["kitties", "dogs"]
    t = spark.createDataFrame([("Oslo", 1, 1, "west", "cloudy"), ("Cairo", 31, 11, "north", "clear")], "city string, temperature int, wind_speed int, wind_direction string, state string")
    got = {r.city: r.report for r in weather.reports(t, "[CITY]: [STATE], [TEMPERATURE] degrees, [WIND_SPEED] kilometers an hour from the [WIND_DIRECTION]").collect()}
    assert got == {"Oslo": "Oslo: cloudy, 1 degree, 1 kilometer an hour from the west", "Cairo": "Cairo: clear, 31 degrees, 11 kilometers an hour from the north"}


def test_dates(spark):
    full = "<date><month>1</month><day>2</day><year>1985</year></date>"
    turned = "<date><day>2</day><month>1</month><year>1985</year></date>"
    cases = {
        "January 2, 1985": full, "January the 2nd, 1985": full, "JAN. 02 1985": full, "2 January, 1985": turned, "the 2nd of January, 1985": turned, "2/1/1985": turned,
        "1985/1/2": "<date><year>1985</year><month>1</month><day>2</day></date>",
        "I met John on June 1, 1985 in Colorado.": "I met John on <date><month>6</month><day>1</day><year>1985</year></date> in Colorado.",
        "Woodstock in 1873, on 30 November 1874, and sept 3rd": "Woodstock in 1873, on <date><day>30</day><month>11</month><year>1874</year></date>, and <date><month>9</month><day>3</day></date>",
        "in May 2001": "in <date><month>5</month><year>2001</year></date>", "the 22nd of march": "<date><day>22</day><month>3</month></date>",
        "no 1999 date, 32/1/1999, 1/13/1999, mayor 3, 2/1/1985/4": "no 1999 date, 32/1/1999, 1/13/1999, mayor 3, 2/1/1985/4",
    }
    assert one(spark, dates.tag_dates, *cases) == list(cases.values())


SOUNDS = {"anarquista": "anarkista", "cantar": "kantar", "gañir": "gaɲir", "hacer": "aser", "hijo": "ixo", "llave": "ʝabe", "pero": "peɾo", "perro": "pero", "vivir": "bibir", "chico": "tʃiko", "guerra": "guera", "pingüino": "pingwino"}


def test_words(spark):
    assert one(spark, g2p.sounds, *SOUNDS, "x-y", "Ana") == [*SOUNDS.values(), None, None]
    assert one(spark, lambda c: case.case_of(c, "inessive"), "talo", "kylä", "tie") == ["talossa", "kylässä", "tiessä"]
    t = tagger.Tagger("v", ("ab", "abc", "c"), "abcd ")
    assert one(spark, t.apply, "abcd c", "xab") == ["<v>abc</v>d <v>c</v>", None]
    with pytest.raises(ArgumentError):
        tagger.Tagger("v", ())
    lex = spark.createDataFrame([("good",), ("home",), ("zoo",)], "w string")
    d = spark.createDataFrame([("4663",)], "d string")
    assert sorted(r.word for r in keypad.decode(d, "d", lex, "w").collect()) == ["good", "home"]
    assert one(spark, lambda c: N.tag_terms(c, ["red", "blue"], "c"), "red blues") == ["<c>red</c> <c>blue</c>s"]
    with pytest.raises(ArgumentError):
        N.tag_terms(F.lit(""), ["a", "ab"], "t")


def test_classes(spark):
    text = "aZ5 \t!é\x0b"
    got = {n: one(spark, lambda c, n=n: N.count_of(c, n), text)[0] for n in N.CLASSES}
    assert got == {"BYTE": 8, "DIGIT": 1, "LOWER": 1, "UPPER": 1, "ALPHA": 2, "ALNUM": 3, "HEX": 2, "SPACE": 2, "NOT_SPACE": 6, "NOT_QUOTE": 8, "PUNCT": 1, "GRAPH": 4}
    raw = spark.createDataFrame([(b"ok\xc3\xa9",), (b"\xc3",), (b"a\0b",), (b"\xed\xa0\x80",)], "b binary")
    assert [r.v for r in raw.select(N.is_valid_utf8(F.col("b")).alias("v")).collect()] == [True, False, False, False]
    assert tuple(raw.select(N.utf8_lead(F.col("b")).alias("v")).first().v) == (2, 1, 1)
    assert one(spark, N.is_regional_indicator, "\U0001f1e9", "D") == [True, False]
    assert one(spark, lambda c: N.join_of(c, "[ab]+", ","), "ab,b", "ab,", "") == [True, False, False]
    assert one(spark, lambda c: N.repeated(c, "ab", 1, 2), "ab", "ababab") == [True, False]
    assert one(spark, N.escape, "a[b]\\") == ["a\\[b\\]\\\\"]
    assert one(spark, lambda c: N.edit_distance(c, F.lit("e"), by_bytes=True), "é") == [2] and one(spark, lambda c: N.edit_distance(c, F.lit("e"), 1), "é", "abc") == [1, None]
    assert one(spark, lambda c: N.within(c, "ab-]"), "a-]", "c") == ["a-]", None]


def test_morphology(spark):
    case_f, number = Mo.Feature("case", "nom", "gen"), Mo.Feature("num", "sg", default="pl")
    noun = Mo.Category(number, case_f)
    assert noun.names == ("case", "num") and len(noun.vectors()) == 4 and noun.fill({"case": "gen"}) == [{"case": "gen", "num": "pl"}] and noun.frame(spark).count() == 4
    v = lambda *p: Mo.FeatureVector(noun, *p)
    assert v("case=nom").unify(v("num=sg")) == v("num=sg", "case=nom") and v("case=nom").unify(v("case=gen")) is None and v("case=nom").unify(Mo.FeatureVector(Mo.Category(case_f), "case=nom")) is None
    for bad in ("case", "case=acc", "x=y"):
        with pytest.raises(ArgumentError):
            v(bad)
    two = spark.createDataFrame([((None, "sg"), ("nom", None)), (("gen", "sg"), ("nom", None))], "a struct<case:string,num:string>, b struct<case:string,num:string>")
    assert [r.u and tuple(r.u) for r in two.select(Mo.unify_columns(F.col("a"), F.col("b"), noun.names).alias("u")).collect()] == [("nom", "sg"), None]
    base = Mo.Paradigm(noun, [(Mo.suffix("+a"), v("case=nom", "num=sg")), (Mo.suffix("+ae"), v("case=gen", "num=sg"))], v("case=nom", "num=sg"), ["aqu", "ros"], name="first")
    p = Mo.Paradigm(noun, [(Mo.suffix("+as"), v("case=nom", "num=pl")), (Mo.suffix("+y"), v("case=gen", "num=sg"))], v("case=nom", "num=sg"), ["aqu", "mus"], [lambda c: F.regexp_replace(c, "s\\+y", "z+y")], parent=base)
    assert {(r.form, r.surface, r.features) for r in p.forms(spark).where("stem = 'mus'").collect()} == {("mus+as", "musas", "[case=nom][num=pl]"), ("muz+y", "muzy", "[case=gen][num=sg]"), ("mus+a", "musa", "[case=nom][num=sg]")}
    words = spark.createDataFrame([("muzy",), ("aquas",), ("none",)], "w string")
    assert {tuple(r) for r in p.analyze(words, "w").collect()} == {("muzy", "muz+y", "[case=gen][num=sg]"), ("aquas", "aqu+as", "[case=nom][num=pl]")}
    assert {tuple(r) for r in p.tag(words, "w").collect()} == {("muzy", "[case=gen][num=sg]"), ("aquas", "[case=nom][num=pl]")}
    assert {(r.w, r.lemma) for r in p.lemmatize(words, "w").collect()} == {("muzy", "musa"), ("aquas", "aqua")}
    lemmas = spark.createDataFrame([("musa",)], "l string")
    assert [tuple(r) for r in p.inflect(lemmas, "l", v("case=gen", "num=sg")).collect()] == [("musa", "muzy")]
    with pytest.raises(ArgumentError):
        Mo.Paradigm(noun, [(Mo.suffix("+a"), v("case=gen"))], v("case=nom"), ["x"])
    with pytest.raises(ArgumentError):
        Mo.Paradigm(noun, base.slots, v("case=nom", "num=sg"), ["x"], boundary="#", parent=base)
    assert [r.stem_id for r in Mo.stem_ids(spark.createDataFrame([("b",), ("a",)], "stem string")).orderBy("stem").collect()] == ["__0__", "__1__"]


def test_chat_sources(spark):
    lex = spark.createDataFrame([("cool",), ("col",), ("warthog",), ("chicken",)], "w string")
    tokens = spark.createDataFrame([(t,) for t in "cooooool chicken wrthg wthg z delish kooooooool zomggggg".split()], "t string")
    got = {}
    for r in chat.candidates(tokens, "t", lex, "w").where("weight < 10").collect():
        got.setdefault(r.token, set()).add(r.ostring)
    assert got == {"cooooool": {"cool", "col"}, "chicken": {"chicken"}, "wrthg": {"warthog"}, "wthg": {"warthog"}, "delish": {"delicious"}, "kooooooool": {"cool"}, "zomggggg": {"oh my god"}}


def test_chat(spark):
    lex = spark.createDataFrame([("please",), ("so",), ("good",), ("text",), ("tiger",)], "w string")
    tokens = spark.createDataFrame([("soooo",), ("txt",), ("plzzz",), ("good",), ("qq",)], "t string")
    more = spark.createDataFrame([("qq", "cry")], "a string, b string")
    got = {(r.token, r.ostring): r.weight for r in chat.candidates(tokens, "t", lex, "w", more).collect()}
    assert got == {("soooo", "so"): 1.0, ("txt", "text"): 1.0, ("plzzz", "please"): 1.0, ("good", "good"): 0.0, ("qq", "cry"): 1.0}
    corpus = spark.createDataFrame([("so good",), ("so good",), ("text please",)], "s string")
    model = chat.bigram_model(corpus, "s")
    texts = spark.createDataFrame([(1, "Soooo good"), (2, "txt plzzz"), (3, "")], "k int, s string")
    found = chat.candidates(texts.select(F.explode(F.split(F.lower("s"), " ")).alias("t")), "t", lex, "w")
    assert {r.k: r.normalized for r in chat.best_sentences(texts, "s", found, model).collect()} == {1: "so good", 2: "text please", 3: None}
    counts = {tuple(r.gram): r.n for r in chat.ngram_counts(corpus, "s", 2).collect()}
    assert counts["so", "good"] == 2 and counts["<s>", "so"] == 2
