"""Surrogates for personal data, by DataFrame functions only.

Emails, IPv4 and IPv6 addresses, IBANs, payment card numbers, phone and
social-security numbers, access tokens (hexadecimal, JWT, or with a known prefix),
and names after a title are found by pattern. Each distinct
entity gets one surrogate everywhere: keyed by a secret, of the same type and
format (separators, letter case, number of digits, top-level domain, country
code, Luhn validity, private address ranges), script and, for names, gender.
Candidates that meet another surrogate or a real entity of the corpus are keyed
again, so distinct entities stay distinct and none is turned into another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, hot, lookup

#: The key of the query; a deployment passes its own.
KEY = "lumen-surrogates-1"
#: Keys tried for an entity whose surrogate is a real entity.
MAX_ROUNDS = 6

# fixed values: the patterns, in the order in which an entity is classified
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.\p{L}{2,24})"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}+(?![0-9A-Za-z])"
TOKEN = r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[opsur]_[0-9A-Za-z]{20,255}+|github_pat_[0-9A-Za-z_]{20,255}+|glpat-[0-9A-Za-z_-]{20,64}+|sk-[0-9A-Za-z_-]{20,255}+|[srp]k_(?:live|test)_[0-9A-Za-z]{16,255}+|xox[abprs]-[0-9A-Za-z-]{10,255}+|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,4096}+\.[0-9A-Za-z_-]{8,8192}+\.[0-9A-Za-z_-]{8,4096}+)"
#: What of a token stays.
TOKEN_PREFIX = r"^(?:AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|sk-|[srp]k_(?:live|test)_|xox[abprs]-|AIza|eyJ)"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![0-9A-Za-z:])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = "|".join([
    r"\+\d{1,3}[^\w(\n]{0,5}\(\d{2,4}\)[^\w\n]{0,5}\d{3}-\d{4}(?!\d)",
    r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\w.+-])(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?![\w-])",
    r"(?<![\w.+-])(?:1[ .-])?[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d)",
    r"(?<![\w.+-])1?[2-9]\d{9}(?![\w-]|\.\d)",
    r"\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)",
    r"(?<![\w+])\+\d{8,15}(?!\d)",
    r"(?<![\d-])\d{3}-\d{4}(?![\d-])",
])
TITLES_M = ["Mr", "Dr", "Prof", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:\p{Lu}\p{Ll}++)*+(?:[-'’]\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+)*+"
NAME = rf"(?<!\p{{L}})(?:{'|'.join(TITLES_M + TITLES_F)})\.? {_WORD}(?: {_WORD})?"
PATTERN = "|".join([EMAIL, TOKEN, SECRET, IPV6, IBAN, IPV4, CARD, SSN, PHONE, NAME])
#: What every entity but a name holds; texts without it, and without a title, are not scanned.
HINT = rf"[0-9@]|{'|'.join(TITLES_M + TITLES_F)}|[a-fA-F]{{32}}|(?:gh[opsur]|github_pat|[srp]k_live|[srp]k_test)_|(?:glpat|sk|xox[abprs])-|AKIA|ASIA|AIza|eyJ"
DIGITS, LATIN, CYRILLIC, GREEK = "0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "sa", "to", "va", "we", "ro", "li"], "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "са", "то", "ва", "зе", "ро", "ли"]}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на"}
# end of fixed values
#: Letters and figures of none of these alphabets.
ODD = rf"[\p{{L}}\p{{N}}&&[^0-9A-Za-z{CYRILLIC}{GREEK}{ACCENTED}]]"


def entities(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)), F.array().cast("array<string>"))


def kind(e: Column) -> Column:
    whole = lambda p: e.rlike(f"^(?:{p})$")
    return (
        F.when(e.contains("@"), "email").when(whole(TOKEN), "token").when(whole(SECRET), "secret").when(whole(IPV6), "ipv6").when(whole(IBAN), "iban").when(whole(IPV4), "ipv4").when(whole(CARD), "card")
        .when(whole(SSN), "ssn").when(e.rlike(r"\d"), "phone").otherwise("name")
    )


def canonical(e: Column) -> Column:
    """What two spellings of one entity share: its digits (a leading + kept), lower case, or a name without its title."""
    k = kind(e)
    digits = F.concat(F.when(e.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(e, r"\D", ""))
    gender = F.when(e.rlike(f"^(?:{'|'.join(TITLES_F)})\\b"), "f").otherwise("m")
    return F.when(k.isin("card", "ssn", "phone"), digits).when(k == "token", e).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(k == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(e, r"^\S+ ", "")))).otherwise(F.lower(e))


def _draw(stream: Column, i: Column) -> Column:
    """The i-th number, 0 to 65535, of a hexadecimal stream of 128 digits."""
    return F.conv(F.substr(stream, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _stream(*seed: Column) -> Column:
    """128 hexadecimal digits from a seed."""
    return F.sha2(F.concat_ws("|", *seed).cast("binary"), 512)


def _shifted(part: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each character moved on within its own alphabet by the stream; characters of no alphabet stay. Of a hexadecimal part, all characters are one alphabet."""
    def move(alphabet: str, c: Column, i: Column) -> Column:
        return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + _draw(stream, i), F.lit(len(alphabet))) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        hexes = DIGITS + LATIN[:6]
        out = F.when(hexadecimal & (F.instr(F.lit(hexes), c) > 0), move(hexes, c, i))
        for alphabet in (DIGITS, LATIN, LATIN.upper(), CYRILLIC, GREEK, ACCENTED):
            out = out.when(F.instr(F.lit(alphabet), c) > 0, move(alphabet, c, i))
        return out.otherwise(c)

    return F.when(F.length(part) > 0, F.array_join(F.transform(F.split(part, "", -1), one), "")).otherwise("")


def permuted(df: DataFrame, column: str, seed: Column, hexadecimal: Column, rounds: int = 4) -> DataFrame:
    """`df` with text `column` permuted among the texts of its format by a keyed Feistel network: in turn, one half is shifted by a hash of the other."""
    half = F.ceil(F.length(column) / 2).cast("int")
    df = df.withColumns({"_l": F.substr(column, F.lit(1), half), "_r": F.substr(column, half + 1)})
    for j in range(rounds):
        moved, other = ("_l", "_r") if j % 2 == 0 else ("_r", "_l")
        # the stream is a column of its own: one hash a text, not one a character
        df = df.withColumn("_s", _stream(seed, F.lit(str(j)), F.length(column).cast("string"), F.col(other)))
        df = df.withColumn(moved, _shifted(F.col(moved), F.col("_s"), hexadecimal))
    return df.withColumn(column, F.concat("_l", "_r")).drop("_l", "_r", "_s")


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check over a text of digits, mod 10; 0 is valid."""
    value = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    return F.aggregate(F.transform(F.reverse(F.split(digits, "", -1)), lambda c, i: value(c.cast("int"), i)), F.lit(0), lambda t, x: t + x) % 10


def parts(k: Column, c: Column) -> dict[str, Column]:
    """Of a canonical form: what stays in front, what is permuted, whether that is hexadecimal, and the domain's name and ending of an email."""
    octet = lambda i: F.lpad(F.lower(F.hex(F.get(F.split(c, r"\."), i).cast("long"))), 2, "0")
    proper = c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$")
    private = F.regexp_extract(c, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    address = F.substr(F.concat(*[octet(i) for i in range(4)]), (F.size(F.split(private, r"\.")) - 1) * 2 + 1)
    country = F.when(c.startswith("+"), F.substr(c, F.lit(1), F.greatest(F.lit(2), F.length(c) - 10))).otherwise("")
    none = F.lit("")
    kept = F.when(k == "token", F.regexp_extract(c, TOKEN_PREFIX, 0)).when(k == "iban", F.substr(c, F.lit(1), F.lit(2))).when(k == "phone", country).when(k == "card", F.substr(c, F.lit(1), F.lit(1))).when((k == "ipv4") & proper, private).otherwise(none)
    rest = F.substr(c, F.length(kept) + 1)
    body = F.when(k == "email", F.regexp_extract(c, "^([^@]*)@", 1)).when((k == "ipv4") & proper, address).when(k == "card", F.substr(rest, F.lit(1), F.length(rest) - 1)).when(k == "name", none).otherwise(rest)
    return {
        "_kept": kept, "_body": body, "_hex": k.isin("secret", "ipv6") | ((k == "ipv4") & proper),
        "_site": F.when(k == "email", F.regexp_extract(c, r"@(.*)\.[^.]*$", 1)).otherwise(none), "_end": F.when(k == "email", F.regexp_extract(c, r"\.([^.]*)$", 1)).otherwise(none),
    }


def _name(c: Column, attempt: int, key: str) -> Column:
    """A name of syllables, longer with each attempt."""
    stream = _stream(F.lit(key), F.lit("name"), F.lit(str(attempt)), c)
    gender = F.substr(c, F.lit(1), F.lit(1))

    def word(of: str, first: int, n: int) -> Column:
        return F.concat(*[F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[of]]), _draw(stream, F.lit(first + j)) % 16 + 1) for j in range(n)])

    def name(of: str) -> Column:
        given = F.concat(word(of, 0, 3), F.when(gender == "f", ENDINGS[of, "f"]).otherwise(ENDINGS[of, "m"]))
        family = word(of, 4, 4 + 4 * attempt)
        return F.concat(gender, F.lit(":"), F.when(F.contains(c, F.lit(" ")), F.concat(given, F.lit(" "), family)).otherwise(family))

    return F.when(c.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))


def candidates(df: DataFrame, attempt: int, key: str) -> DataFrame:
    """`df` (k, c) with `s`, the surrogate of canonical form c of kind k, in canonical form."""
    k, c = F.col("k"), F.col("c")
    seed = F.concat_ws("|", F.lit(key), k, F.lit(str(attempt)))
    df = df.withColumns(parts(k, c))
    df = permuted(df, "_body", F.concat_ws("|", seed, F.col("_kept")), F.col("_hex"))
    # one domain has one surrogate, whoever is in it
    df = permuted(df, "_site", F.concat_ws("|", F.lit(key), F.lit("domain"), F.col("_end")), F.lit(False))
    body = F.col("_body")
    address = F.array_join(F.transform(F.sequence(F.lit(1), F.length(body) - 1, F.lit(2)), lambda i: F.conv(F.substr(body, i, F.lit(2)), 16, 10)), ".")
    want = (F.lit(10) + luhn(c) - luhn(F.concat("_kept", body, F.lit("0")))) % 10
    # letters of no alphabet are replaced by a hash of the whole
    odd = c.rlike(ODD)
    spelt = F.concat(F.regexp_replace(body, ODD, "x"), F.substr(F.translate(_stream(seed, c), DIGITS, "ghijklmnop"), F.lit(1), F.lit(12)))
    local = F.when(odd, spelt).otherwise(body)
    s = (
        F.when(k == "email", F.concat(local, F.lit("@"), F.regexp_replace("_site", ODD, "x"), F.lit("."), F.col("_end"))).when((k == "ipv4") & F.col("_hex"), F.concat("_kept", address))
        .when(k == "card", F.concat(F.col("_kept"), body, want.cast("string"))).when(k == "name", _name(c, attempt, key)).otherwise(F.concat("_kept", body))
    )
    return df.withColumn("s", s).drop("_kept", "_body", "_hex", "_site", "_end")


def render(e: Column, k: Column, s: Column) -> Column:
    """Surrogate `s` (canonical) in the format of the entity as it is written."""
    digits = F.regexp_replace(s, r"\D", "")
    overlaid = F.aggregate(
        F.split(e, "", -1), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["out"], F.substr(digits, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
    )["out"]
    cased = F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(s)).otherwise(s)
    named = F.concat(F.regexp_extract(e, r"^(\S+ )", 1), F.initcap(F.regexp_replace(s, "^.:", "")))
    spaced = F.aggregate(
        F.split(e, "", -1), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, c: F.when(c == " ", F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))).otherwise(F.struct(F.concat(a["out"], F.substr(s, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))),
    )["out"]
    return F.when(k.isin("card", "ssn", "phone"), overlaid).when(k == "token", s).when(k == "iban", spaced).when(k == "name", named).when(k == "ipv4", s).otherwise(cased)


def surrogates(real: DataFrame, key: str) -> DataFrame:
    """(k, c, s): a surrogate for each distinct entity (k, c) of `real`, distinct within its kind.

    None is a real entity of the corpus as long as one of MAX_ROUNDS keys gives
    a free one. What is left after them, in a kind whose space is nearly full,
    gets what the first key gives: the form of another real entity, itself
    replaced, so that surrogates still are distinct. (A form that the first key
    maps to itself, one in the size of the kind's space, then stays.) The result
    is a written table.
    """
    pairs = real.select("k", "c")
    taken, left, tables = None, pairs, []
    for attempt in range(MAX_ROUNDS):
        # written first: a join on s would have Spark copy its expression into filters
        drawn = cut(candidates(left, attempt, key), "pii-drawn")
        tried = drawn.join(real.select("k", F.col("c").alias("s"), F.lit(True).alias("_real")), ["k", "s"], "left")
        if taken is not None:
            tried = tried.join(taken.select("k", "s", F.lit(True).alias("_taken")), ["k", "s"], "left")
        else:
            tried = tried.withColumn("_taken", F.lit(None).cast("boolean"))
        first = tried.groupBy("k", "s").agg(F.min("c").alias("_first"))
        judged = cut(tried.join(first, ["k", "s"]).select("k", "c", "s", (F.col("_real").isNull() & F.col("_taken").isNull() & (F.col("c") == F.col("_first"))).alias("ok")), "pii-try")
        tables.append(judged)
        forget(drawn)
        won = judged.where("ok").select("k", "c", "s")
        taken = won if taken is None else taken.union(won)
        left = judged.where("not ok").select("k", "c")
        if not left.limit(1).count():
            break
    else:
        taken = taken.union(candidates(left, 0, key).select("k", "c", "s"))
    out = cut(taken, "pii-known")
    forget(*tables)
    return out


def replace(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with surrogates in its text, and `n_entities` (a column of that name is replaced).

    Null and empty texts, and texts without an entity, stay as they are, with
    n_entities 0. Repeated rows get equal texts: a row is known by its id and
    its text, so null ids and ids that occur with several texts are safe. Long
    texts are processed whole. The table of distinct entities is distributed,
    never gathered; only texts that hold a hint are joined.
    """
    cols = [c for c in docs.columns if c != "n_entities"]
    at = {c: f"c{i}" for i, c in enumerate(cols)}
    safe = docs.select(*cols).toDF(*at.values())
    text, ident = F.col(at[text_col]), F.col(at[id_col])
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    mark = F.md5(text.cast("binary"))
    some = safe.where(hinted).select(ident.alias("_id"), mark.alias("_t"), entities(text).alias("_e")).where(F.size("_e") > 0)
    some = cut(some.groupBy("_id", "_t").agg(F.first("_e").alias("_e")), "pii-found")
    each = some.select("_id", "_t", F.posexplode("_e").alias("p", "e")).select("_id", "_t", "p", "e", kind(F.col("e")).alias("k"), canonical(F.col("e")).alias("c"))
    real = cut(each.groupBy("k", "c").agg(F.count("*").alias("n")), "pii-real")
    total = real.agg(F.sum("n")).first()[0] or 0
    known = surrogates(real, key)
    done = lookup(each, known, ["k", "c"], hot(real, ["k", "c"], total)).select("_id", "_t", F.struct("p", render(F.col("e"), F.col("k"), F.col("s")).alias("r")).alias("x"))
    done = cut(done.groupBy("_id", "_t").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("_r")), "pii-done")
    forget(some, real, known)
    plain = F.split(text, PATTERN, -1)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(plain, 1, F.size("_r")), F.col("_r"), lambda a, b: F.concat(a, b)), ""), F.element_at(plain, -1))
    hit = safe.where(hinted).join(done, ident.eqNullSafe(F.col("_id")) & (mark == F.col("_t")), "left")
    hit = hit.select(*[F.when(F.col("_r").isNotNull(), rebuilt).otherwise(text).alias(c) if c == at[text_col] else F.col(c) for c in at.values()], F.coalesce(F.size("_r"), F.lit(0)).alias("n_entities"))
    rest = safe.where(~hinted).withColumn("n_entities", F.lit(0))
    return hit.union(rest).toDF(*cols, "n_entities")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return replace(read(spark, sf_dir, "documents").select("doc_id", "text"))
