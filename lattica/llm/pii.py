"""PII replaced by surrogates (operator 5); DataFrame functions only.

Entities are found by one pattern: e-mail and IP addresses (4 and 6), phone numbers (international,
and national ones in groups), card, IBAN and social-security numbers, secrets (hexadecimal ones,
keys of known forms, and what follows "token =" and the like), and names of people: a given name of the
lexicon and a surname, or words in capitals after a title or a cue such as "name:", in Latin or
Cyrillic.  A surname found so is found again where it stands alone in the same text.

An entity's canonical form drops case, accents and separators, so mentions in several formats get
one surrogate (coreference).  Given names and surnames are replaced apart, so relatives keep a common
surname and "Mrs Garcia" goes with "Maria Garcia".  The surrogate is drawn by a keyed SHA-256 of the
canonical form: digits stay digits, letters stay letters of their script and case, separators stay;
octets of an address stay in range, a card number that passes the Luhn check gets one that passes,
an IBAN gets its check digits, a phone number keeps its country's code and a key its prefix, a given
name keeps its gender (of the lexicon, else by its ending) and its script.

Distinct canonical forms are gathered over the whole corpus and checked: a surrogate that another
form has, or that is itself an entity of the corpus, is drawn again with the next round number, until
none is left.  Later rounds draw from larger spaces (one more letter, digit, syllable or name), so
the rounds end after a few; beyond ``ROUNDS`` it raises RuntimeError.

The key is the session's ``spark.lattica.pii.key``.  Where that is unset, a random one is set for the
session: surrogates then agree within a session, and nobody can invert them later.

Only texts with an entity meet the surrogates in a join; all others pass as they are.  Null stays null,
empty stays empty.  Rows that repeat a doc_id are each done by their own text.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import column, free, pin, row_key

# Given names that surrogates are drawn of, by gender and script.
POOL = {
    "gf": "Maria Anna Elena Laura Julia Sofia Emma Alice Clara Marta Ines Helen Nora Olivia Lucy Irene".split(),
    "gm": "John Peter Paul David Daniel Martin Thomas Robert James Carlos Miguel Hans Karl Louis Henri Simon".split(),
    "gF": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна".split(),
    "gM": "Иван Пётр Сергей Алексей Дмитрий Николай Павел Андрей".split(),
}
# Given names that begin a name without any cue.
FEMALE = """Maria Anna Elena Laura Julia Sofia Emma Alice Clara Marta Ines Helen Nora Olivia Lucy Irene Mary Patricia Jennifer
Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Emily Michelle Amanda Rebecca Priya Aisha Fatima Yuki
Mei Ingrid Greta Camille Chloe Lucia Carmen Isabel Ana Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Екатерина Юлия""".split()
MALE = """John Peter Paul David Daniel Martin Thomas Robert James Carlos Miguel Hans Karl Louis Henri Simon Michael William Richard
Joseph Charles Christopher Matthew Anthony Mark Steven Andrew Joshua Kevin Brian George Edward Wei Ahmed Mohammed Omar Raj Arjun
Hiroshi Kenji Lars Sven Jürgen Klaus Pierre Jean Antoine José Juan Pablo Diego Luca Marco Иван Пётр Сергей Алексей Дмитрий
Николай Павел Андрей Михаил Владимир Александр""".split()
# Syllables of surnames, and the letters that stand in for those of a script.
SYLLABLES = {"sl": "ba ri mon tel dor va lin ker sa mu nel gar to pin ros wel".split(), "sc": "ба ри мон тел дор ва лин кер са му нел гар то пин рос вел".split()}
LETTERS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüýñçё", "aaaaaaeeeeiiiiooooouuuuyncе")
ROUNDS = 64
#: Texts that one entity may stand in before its mentions are dealt to several tasks.
HOT = 50_000

TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra|Sr|г-н|г-жа)\.?"
PARTICLE = r"(?:van|von|der|den|de|del|della|da|di|la|le|bin|al)"
WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
LABEL = r"[\p{L}\p{N}-]"
EMAIL = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+@(?:{LABEL}++\.)+\p{{L}}{{2,}}+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
HEX = r"[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<!:)(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]*\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![0-9A-Za-z:])"
PHONE = r"(?<!\d[.+-])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){1,4}[ .-]?\d{3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![.-]?\d)"
CARD = r"(?:\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?![\dA-Fa-f])"
SSN = r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])"
# Codes of the countries that have IBANs.
COUNTRIES = """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW
KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK""".split()
IBAN = rf"(?:{'|'.join(COUNTRIES)})\d\d(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])"
HEXED = r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ)"
KEYED = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16,}+|(?:gh[pousr]_|github_pat_)\w{20,}+|sk-[\w-]{20,}+|xox[abprs]-[\w-]{10,}+|AIza[\w-]{30,}+|eyJ[\w-]+\.[\w-]+\.[\w-]*+)"
GIVEN = r"(?<=(?:token|secret|password|passwd|api_key|apikey) ?[=:] ?[\"']?)[\w+/.=-]{8,}+"
SECRET = f"(?:{HEXED}|{KEYED}|{GIVEN})"
REST = rf"(?: \p{{Lu}}\.| {WORD}){{0,2}}(?: {PARTICLE}){{0,2}} {WORD}"
LEXICON = "|".join([*FEMALE, *MALE, *(n.upper() for n in FEMALE + MALE if len(n) > 3)])
CUE = r"(?<=(?:[Nn]ame|[Cc]ontact|[Aa]uthor|[Ss]igned|[Ff]rom|[Aa]ttn)[:=] ?)"
NAME = rf"(?=\p{{Lu}}|г-)(?:{TITLE} {WORD}(?:(?: {PARTICLE}){{0,2}} {WORD})?|(?:{LEXICON}){REST}|{CUE}{WORD}{REST})(?![\p{{L}}\d])"
#: Where no word begins, nothing does; most places go by the first two tests. Phone's and card's groups are the only capturing ones.
MASTER = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}+(])(?:{EMAIL}|(?=[+(\d])(?:{IP}|{PHONE}|{CARD}|{SSN})|(?=[0-9A-Fa-f]){IP6}|{SECRET}|(?=[A-Z]){IBAN}|{NAME})"
#: The country's code at the start of an international number.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def session_key(spark: SparkSession) -> str:
    name = "spark.lattica.pii.key"
    key = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if not key:
        spark.conf.set(name, key := secrets.token_hex(32))
    return key


# ---- forms ----------------------------------------------------------------------------


def kind_of(entity: Column) -> Column:
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    out = F.when(entity.contains("@"), "email").when(whole(IP), "ip").when(whole(CARD.replace(r"\2", r"\1")), "card").when(whole(SSN), "ssn").when(whole(PHONE), "phone").when(whole(HEXED), "hex")
    return out.when(whole(IP6), "ip6").when(whole(KEYED), "secret").when(whole(IBAN), "iban").when(entity.rlike(rf"^(?:{TITLE}|{WORD})( |$)") & ~entity.rlike(r"\d"), "name").otherwise("secret")


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), *ACCENTS)


def canonical(kind: Column, entity: Column) -> Column:
    bare = F.regexp_replace(entity, r"[^0-9A-Za-z]", "")
    # a national number of ten digits goes with the international one
    phone = F.when(~entity.startswith("+") & (F.length(bare) == 10), F.concat(F.lit("1"), bare)).otherwise(bare)
    return F.when(kind.isin("ip", "ip6", "email", "hex"), F.lower(entity)).when(kind == "secret", entity).when(kind == "phone", phone).otherwise(F.upper(bare))


def _token(tok: Column, last: Column) -> Column:
    """The kind of a word of a name: "-" for what stays, "i" for an initial, g. for a given name, s. for a surname."""
    cyrillic, form = tok.rlike(r"\p{IsCyrillic}"), folded(tok)
    names = lambda ns: F.array(*(F.lit(n.lower().translate(str.maketrans(*ACCENTS))) for n in ns))
    female = F.array_contains(names(FEMALE), form) | (~F.array_contains(names(MALE), form) & form.rlike("[aая]$"))
    given = F.when(cyrillic, F.when(female, "gF").otherwise("gM")).otherwise(F.when(female, "gf").otherwise("gm"))
    out = F.when(tok.rlike(f"^(?:{TITLE}|{PARTICLE})$"), "-").when(tok.rlike(r"^\p{Lu}\.$"), "i")
    return out.when(last, F.when(cyrillic, "sc").otherwise("sl")).otherwise(given)


def _stem(kind: Column, tok: Column) -> Column:
    """The form of a word of a name; Russian surnames of women go with those of men."""
    return F.when(kind == "sc", F.regexp_replace(folded(tok), "(?<=ов|ев|ин)а$", "")).otherwise(folded(tok))


def _words(entity: Column) -> Column:
    """k, f and the word itself for each word of a name."""
    toks = F.split(entity, " ")
    made = F.transform(toks, lambda t, i: F.struct(_token(t, i == F.size(toks) - 1).alias("k"), t.alias("t")))
    return F.transform(made, lambda x: F.struct(x["k"].alias("k"), _stem(x["k"], x["t"]).alias("f"), x["t"].alias("t")))


def parts_of(found: Column) -> Column:
    """The forms (k, f) that the mentions of a text are made of."""
    own = F.transform(found, lambda x: F.when(x["k"] == "name", F.transform(F.filter(_words(x["e"]), lambda w: ~w["k"].isin("-", "i")), lambda w: F.struct(w["k"].alias("k"), w["f"].alias("f")))).otherwise(F.array(F.struct(x["k"].alias("k"), canonical(x["k"], x["e"]).alias("f")))))
    return F.array_distinct(F.flatten(own))


# ---- drawing --------------------------------------------------------------------------


def _number(key: Column, i: Column, below: Column | int) -> Column:
    """A number drawn for place i."""
    digits = F.substring(F.sha2(F.concat(key, F.lit("/"), i.cast("string")), 256), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below).cast("int")


def _of(letters: str, key: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _number(key, i, len(letters)) + 1, F.lit(1))


def _scrambled(key: Column, form: Column, low: Column | int, high: Column, hexadecimal: Column) -> Column:
    """Draws each letter and digit of ``form`` at places low to high anew, in its kind."""

    def one(c: Column, i: Column) -> Column:
        new = F.when(hexadecimal & c.rlike("[0-9a-f]"), _of("0123456789abcdef", key, i)).when(c.rlike("[0-9]"), _of("0123456789", key, i))
        for script, letters in LETTERS.items():
            new = new.when(c.rlike(script), _of(letters, key, i))
        return F.when((i >= low) & (i < high), new.otherwise(c)).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _several(words: list[str], key: Column, n: Column, between: str) -> Column:
    """n words, drawn apart."""
    known = F.array(*(F.lit(w) for w in words))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(known, _number(key, i, len(words)) + 1)), between)


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits, by the remainder mod 97 of the number that the letters stand for."""
    value = F.transform(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int")))
    left = F.aggregate(value, F.lit(0), lambda acc, v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
    return F.lpad((F.lit(98) - left).cast("string"), 2, "0")


def _drawn(kind: Column, form: Column, round_: Column, key_of_all: str) -> Column:
    """The surrogate's canonical form."""
    key = F.sha2(F.concat_ws("|", F.lit(key_of_all), kind, form, round_.cast("string")), 256)
    no, n = F.lit(False), F.length(form)
    more = F.when(round_ >= 4, _scrambled(F.concat(key, F.lit("+")), F.repeat(F.lit("0"), round_ - 3), 0, F.lit(ROUNDS), no)).otherwise("")
    # an address keeps its separators and its top level domain
    top = n - F.length(F.substring_index(form, ".", -1)) - 1
    email = F.concat(more, _scrambled(key, form, 0, top, no))
    octets = F.transform(F.split(form, r"\."), lambda o, i: F.when(F.length(o) == 3, _number(key, i, 156) + 100).when(F.length(o) == 2, _number(key, i, 90) + 10).otherwise(_number(key, i, 9) + 1).cast("string"))
    # past the first rounds, an address keeps no octet's length
    wide = F.transform(F.split(form, r"\."), lambda o, i: (_number(key, i, 254) + 1).cast("string"))
    ip = F.when(round_ >= 4, F.array_join(wide, ".")).otherwise(F.array_join(octets, "."))
    phone = F.concat(_scrambled(key, form, F.length(F.regexp_extract(form, COUNTRY, 0)), n, no), more)
    digits = F.concat(_scrambled(key, form, 0, n, no), more)
    # a card keeps its first digit, its issuer's kind
    number = F.concat(_scrambled(key, form, 1, n, no), more)
    stem = F.substring(number, F.lit(1), F.length(number) - 1)
    ends = F.filter(F.array(*(F.lit(str(i)) for i in range(10))), lambda d: F.call_function("luhn_check", F.concat(stem, d)))
    card = F.when(F.call_function("luhn_check", form), F.concat(stem, F.element_at(ends, 1))).otherwise(number)
    country, rest = F.substring(form, 1, 2), F.concat(F.substring(_scrambled(key, form, 4, n, no), F.lit(5), n), more)
    iban = F.concat(country, _iban_check(country, rest), rest)
    hexed = F.concat(_scrambled(key, form, 0, n, F.lit(True)), more)
    keyed = F.concat(_scrambled(key, form, F.length(F.regexp_extract(form, f"^{PREFIX}", 0)), n, no), more)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", hexed).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "hex", hexed).when(kind == "secret", keyed)
    for k, words in POOL.items():
        out = out.when(kind == k, F.lower(_several(words, key, 1 + F.floor(round_ / 4).cast("int"), "-")))
    for k, words in SYLLABLES.items():
        out = out.when(kind == k, _several(words, key, round_ + 3, ""))
    return out.otherwise(digits)


def surrogates(forms: DataFrame, key: str) -> DataFrame:
    """(k, f, drawn) for the distinct forms (k, f); distinct forms of a kind stay distinct."""
    k, f, tasks = F.col("k"), F.col("f"), int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = forms.select("k", F.col("f").alias("drawn"), (~k.startswith("g")).alias("real"))
    now = pin(forms.select("k", "f").repartition(tasks, "k", "f").withColumn("round", F.lit(0)).withColumn("drawn", _drawn(k, f, F.col("round"), key)))
    for turn in range(1, ROUNDS + 1):
        first = now.groupBy("k", "drawn").agg(F.min(F.struct("round", "f")).alias("first"), F.count("*").alias("n"))
        taken = first.join(real, ["k", "drawn"], "left").filter("n > 1 or real or drawn = first.f")
        again = pin(now.join(taken, ["k", "drawn"]).filter("real or first.f <> f or drawn = f").select("k", "f"))
        if again.isEmpty():
            return now
        new = again.repartition(tasks, "k", "f").withColumn("round", F.lit(turn)).withColumn("drawn", _drawn(k, f, F.col("round"), key))
        old, now = now, pin(now.join(again, ["k", "f"], "left_anti").select("k", "f", "round", "drawn").unionByName(new))
        free(old, again)
    raise RuntimeError("surrogates still collide")


# ---- texts ----------------------------------------------------------------------------


def _cased(word: Column, drawn: Column) -> Column:
    """A drawn name in the case of the word that it stands for."""
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(drawn)).otherwise(F.array_join(F.transform(F.split(drawn, "-"), lambda p: F.initcap(p)), "-"))


def _name(entity: Column, get, key: str) -> Column:
    def one(w: Column) -> Column:
        new = F.when((w["k"] == "sc") & (folded(w["t"]) != w["f"]), F.concat(get(w["k"], w["f"]), F.lit("а"))).otherwise(get(w["k"], w["f"]))
        initial = F.concat(_of("ABCDEFGHIJKLMNOPRSTVW", F.sha2(F.concat(F.lit(key), w["t"]), 256), F.lit(0)), F.lit("."))
        return F.when(w["k"] == "-", w["t"]).when(w["k"] == "i", initial).otherwise(_cased(w["t"], new))

    return F.array_join(F.transform(_words(entity), one), " ")


def _refilled(entity: Column, drawn: Column) -> Column:
    """A drawn number in the separators of the mention, which is short."""
    rank = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^0-9A-Za-z]", ""))
    one = lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(drawn, rank(i) + 1, F.lit(1))).otherwise(c)
    return F.concat(F.array_join(F.transform(F.split(entity, ""), one), ""), F.substring(drawn, rank(F.length(entity)) + 1, F.length(drawn)))


def _dressed(x: Column, get, key: str) -> Column:
    """The surrogate of a mention (e, k) in the mention's format."""
    e, kind = x["e"], x["k"]
    drawn = get(kind, canonical(kind, e))
    national = (kind == "phone") & ~e.startswith("+") & (F.length(F.regexp_replace(e, r"\D", "")) == 10)
    number = _refilled(e, F.when(national, F.substring(drawn, F.lit(2), F.length(drawn))).otherwise(drawn))
    upper = kind.isin("email", "hex", "ip6") & (F.upper(e) == e) & (F.lower(e) != e)
    return F.when(kind == "name", _name(e, get, key)).when(upper, F.upper(drawn)).when(kind.isin("email", "ip", "ip6", "hex", "secret"), drawn).otherwise(number)


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of ``docs`` with text replaced, and n_entities before the columns it came with.

    A column of docs that is called n_entities gives way to the new one.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    key = key or session_key(docs.sparkSession)
    doc_id, text = column("doc_id"), column("text")
    holds = F.coalesce(text.rlike(MASTER), F.lit(False))
    as_found = lambda es: F.transform(es, lambda e: F.struct(e.alias("e"), kind_of(e).alias("k")))
    some = docs.filter(holds).select(F.struct(*(column(c) for c in names)).alias("row"), F.coalesce(doc_id, F.lit(-1)).alias("d"), row_key(doc_id, text).alias("rk"), text.alias("text"))
    some = some.withColumn("found", as_found(F.regexp_extract_all("text", F.lit(MASTER), F.lit(0))))
    # surnames of the text, as they may stand alone in it
    surnames = F.flatten(F.transform(F.filter("found", lambda x: x["k"] == "name"), lambda x: F.transform(F.filter(_words(x["e"]), lambda w: w["k"].startswith("s")), lambda w: w["t"])))
    bare = F.transform(surnames, lambda s: F.initcap(folded(s)))
    spelt = F.array_distinct(F.concat(surnames, bare, F.transform(F.concat(surnames, bare), lambda s: F.upper(s))))
    some = some.withColumn("pattern", F.when(F.size(surnames) > 0, F.concat(F.lit(MASTER + r"|(?<!\p{L})(?:"), F.array_join(spelt, "|"), F.lit(r")(?!\p{L})"))))
    some = some.withColumn("found", F.when(F.col("pattern").isNull(), F.col("found")).otherwise(as_found(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))))
    some = pin(some.select("row", "d", "rk", "pattern", "found", parts_of(F.col("found")).alias("parts")))

    mentions = some.select("d", "rk", F.explode("parts").alias("p")).select("d", "rk", "p.k", "p.f")
    forms = pin(mentions.groupBy("k", "f").agg(F.count("*").alias("n")))
    table = surrogates(forms, key)
    # an entity of many texts is dealt to several tasks; there are at most 1 / HOT as many such as mentions
    hot = forms.filter(F.col("n") > HOT).select("k", "f", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    if hot.isEmpty():
        met = mentions.join(table, ["k", "f"])
    else:
        hot = pin(hot)
        hot = F.broadcast(hot) if hot.count() <= 1_000_000 else hot
        mine = mentions.join(hot, ["k", "f"], "left").withColumn("salt", F.coalesce(F.pmod("rk", F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        theirs = table.join(hot, ["k", "f"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        met = mine.join(theirs, ["k", "f", "salt"])
    maps = pin(met.groupBy("d", "rk").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "k", "f").alias("key"), F.col("drawn").alias("value")))).alias("m")))

    get = lambda k, f: F.element_at("m", F.concat_ws("|", k, f))
    body = F.col("row").getField("text")
    between = F.when(F.col("pattern").isNull(), F.split(body, MASTER, -1)).otherwise(F.split(body, F.col("pattern"), -1))
    done = some.join(maps, ["d", "rk"]).withColumn("between", between)
    pieces = F.transform("found", lambda x, i: F.concat(F.get("between", i), _dressed(x, get, key)))
    done = done.select(F.size("found").cast("long").alias("n_entities"), "row", F.concat(F.array_join(pieces, ""), F.element_at("between", -1)).alias("new"))
    done = done.select("n_entities", *(F.col("new").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names))
    return docs.filter(~holds).select(F.lit(0).cast("long").alias("n_entities"), *(column(c) for c in names)).unionByName(done)
