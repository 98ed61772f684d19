"""PII surrogates, in DataFrame functions only.

Entities are found by patterns; each has a canonical value (lower-cased address, bare digits), so that
its spellings corefer. A canonical value gets a surrogate of its type, derived from a secret key by
SHA-2: digits for digits, letters for letters of the same script and case, valid octets for an
address, a checksum that holds for a card number or an IBAN (numbers whose checksum fails are no entity),
a name of the same gender and script for a titled name. Surrogates are checked over the whole corpus: two values of one type never share one, and none
equals a value that really occurs; values that collide draw again until none does. A surrogate is
then written in the format of the place where it stands.

A name is found by its title, which says the gender and is no part of its value: "Mrs." and "Ms. Anna
Smith" are one. In one text, a mention under another title or by surname alone goes with the full name of
a gender that fits (the first in order, where several do), and the words of a known name are replaced
where they stand without a title: surnames, and given names before their surname. These further mentions
are not counted in n_entities. A telephone number with a country other than +1 keeps the country's digits
in its value; one of +1 goes with its spelling without a country.

Nulls: a null text stays null and has no entity; a null key is kept. Empty tables give empty results.
Rows equal in key and text are treated alike, and ties go by the order of values. Texts of any length are
read whole; the words of a text with names are looked up among the names of that text. Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Draws after which a value whose format is used up gets its type and a hash instead.
MAX_DRAWS = 24

# Titles by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Dra", "Госпожа")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL = ("Dr", "Prof")
#: One title or more; the short French one has its stop.
TITLES = rf"(?:(?:(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.?|M\.)\s)+"
WORD = r"\p{Lu}[\p{L}'’\-]+"

# The patterns of the entity types, in the order in which they are tried.
PATTERNS = (
    # bounds as an address has them (64 characters, labels of 63); tried only where a word begins, and never anew inside it
    ("email", r"(?<![A-Za-z0-9._%+\-\u00C0-\u024F\u0370-\u052F])[A-Za-z0-9._%+\-\u00C0-\u024F\u0370-\u052F]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,126}[A-Za-z]{2,63}"),
    ("secret", r"\b(?:sk-|pk-|ghp_|gho_|xox[abp]-|AKIA)[A-Za-z0-9_\-]{12,}|\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    (
        "phone",
        r"\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3} [0-9]{4}(?![0-9])"
        r"|(?<![0-9A-Za-z.,+\-])0[1-9](?:[0-9]{8,10}|(?:[ .\-][0-9]{2}){4}|[0-9]{1,3}[ /\-][0-9]{5,8})(?![0-9]|[.,\-][0-9])",
    ),
    ("name", rf"(?<!\p{{L}}){TITLES}{WORD}(?:\s{WORD})?"),
)
# Syllables and endings of invented names by script.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "ga", "jo", "ka", "le", "li", "lo", "ma", "mi", "na", "ne", "ra", "re", "ro", "sa", "so", "ta", "te", "va", "vi"),
    "cyrillic": ("ба", "ве", "га", "да", "зо", "ка", "ле", "ли", "ма", "ми", "на", "не", "ра", "ро", "са", "та"),
}
ENDINGS = {"latin": ("n", "na"), "cyrillic": ("в", "ва")}  # male, female

ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _bare(value: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(value, f"^{TITLES}", "")


#: SQL: what is left of the number of an IBAN v (letters count from 10) after division by 97, with its first four characters last.
_MOD97 = (
    "aggregate(split(concat(substr({v}, 5), substr({v}, 1, 4)), ''), 0, (s, c) -> "
    "if(c between '0' and '9', (s * 10 + int(c)) % 97, (s * 100 + ascii(c) - 55) % 97))"
)


def _canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    title = F.regexp_extract(value, f"^{TITLES}", 0)
    held = lambda titles: title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")
    gender = F.when(held(FEMALE), F.lit("f")).when(held(MALE + ("M",)), F.lit("m")).otherwise(F.lit("n"))
    # numbers of +1 are written with or without it
    country = value.startswith("+") & ~((F.length(digits) == 11) & digits.startswith("1"))
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when((kind == "phone") & country, F.concat(F.lit("+"), digits))
        .when(kind == "phone", F.when(value.startswith("+"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind == "email", F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", F.concat_ws(" ", gender, F.lower(F.regexp_replace(_bare(value), r"\s", " "))))
        .otherwise(value)
    )


def _hex(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """256 hex digits that depend on the key, the value and the draw."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), draw, kind, value), 512) for i in range(2)])


#: SQL: the i-th number (from 0) below 256 of the hex digits; longer values go round.
_BYTE = "cast(conv(substr(_h, 2 * cast(({i}) % 128 as int) + 1, 2), 16, 10) as int)"


def _drawn() -> Column:
    """A surrogate for the columns kind, canon, _h (hex digits)."""
    byte = lambda i: _BYTE.format(i=i)
    letter = lambda i: f"substr('abcdefghijklmnopqrstuvwxyz', {byte(i)} % 26 + 1, 1)"
    accented = lambda i: f"substr('áâäåæçèéêëìíîïñòóôöøùúûü', {byte(i)} % 23 + 1, 1)"
    greek = lambda i: f"substr('αβγδεζηθικλμνξοπρστυφχψω', {byte(i)} % 24 + 1, 1)"
    cyrillic = lambda i: f"substr('абвгдежзиклмнопрстуфхцчшыэюя', {byte(i)} % 28 + 1, 1)"
    cased = lambda e: f"if(c = upper(c) and c <> lower(c), upper({e}), {e})"
    hexed = f"substr('0123456789abcdef', {byte('i')} % 16 + 1, 1)"
    each = (
        "array_join(transform(split({v}, ''), (c, i) -> case "
        f"when c rlike '[0-9]' then cast({byte('i')} % 10 as string) "
        f"when c rlike '[A-Za-z]' then {cased(letter('i'))} "
        f"when c rlike '[\\\\u00C0-\\\\u024F]' then {cased(accented('i'))} "
        f"when c rlike '[\\\\u0370-\\\\u03FF]' then {cased(greek('i'))} "
        f"when c rlike '[\\\\u0400-\\\\u052F]' then {cased(cyrillic('i'))} else c end), '')"
    )
    # the name of an address changes, and so does its domain up to the last dot
    email = f"concat({each.format(v='regexp_extract(canon, _at, 1)')}, regexp_extract(canon, _at, 2))"
    secret = (
        f"if(canon rlike '^[0-9a-fA-F]+$', array_join(transform(split(canon, ''), (c, i) -> if(c = upper(c) and c <> lower(c), upper({hexed}), {hexed})), ''), "
        f"concat(regexp_extract(canon, '^(sk-|pk-|gh[po]_|xox[abp]-|AKIA)', 1), {each.format(v=_tail('canon'))}))"
    )
    ip = "concat_ws('.', " + ", ".join(f"cast({byte(i)} % 254 + 1 as string)" for i in range(4)) + ")"
    body = f"concat(substr(canon, 1, 1), array_join(transform(sequence(1, length(canon) - 2), i -> cast({byte('i')} % 10 as string)), ''))"
    # check digit of the card's first digits: every second one from the right is doubled
    luhn = (
        "aggregate(transform(split(reverse(_b), ''), (c, i) -> if(i % 2 = 0, cast((2 * int(c)) div 10 + (2 * int(c)) % 10 as int), int(c))), 0, (s, x) -> s + x)"
    )
    card = f"transform(array({body}), _b -> concat(_b, cast((10 - {luhn} % 10) % 10 as string)))[0]"
    account = f"concat(substr(canon, 1, 2), '00', {each.format(v='substr(canon, 5)')})"
    iban = f"transform(array({account}), _b -> concat(substr(_b, 1, 2), lpad(cast(98 - {_MOD97.format(v='_b')} as string), 2, '0'), substr(_b, 5)))[0]"
    # the first digit stays, or the country's first two
    fixed = "if(canon like '+%', 3, 1)"
    phone = f"concat(substr(canon, 1, {fixed}), array_join(transform(sequence({fixed}, length(canon) - 1), i -> cast({byte('i')} % 10 as string)), ''))"
    ssn = f"array_join(transform(sequence(0, 8), i -> cast({byte('i')} % 10 as string)), '')"

    def name(script: str) -> str:
        parts = ", ".join(f"'{s}'" for s in SYLLABLES[script])
        male, female = ENDINGS[script]
        one = lambda k: f"initcap(concat({', '.join(f'array({parts})[{byte(8 * k + j)} % {len(SYLLABLES[script])}]' for j in range(4))}, case split(canon, ' ')[0] when 'f' then '{female}' when 'n' then '' else '{male}' end))"
        return f"concat_ws(' ', split(canon, ' ')[0], {one(0)}, if(size(split(canon, ' ')) > 2, {one(1)}, null))"

    return F.expr(
        f"case kind when 'email' then {email} when 'secret' then {secret} when 'ipv4' then {ip} when 'card' then {card} when 'iban' then {iban} "
        f"when 'ssn' then {ssn} when 'phone' then {phone} when 'name' then if(canon rlike '[\\\\u0400-\\\\u052F]', lower({name('cyrillic')}), lower({name('latin')})) end"
    )


def _tail(c: str) -> str:
    return f"regexp_replace({c}, '^(sk-|pk-|gh[po]_|xox[abp]-|AKIA)', '')"


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """kind, canon (distinct) -> kind, canon, surrogate: distinct within a kind, and none a real value.

    Where a format has no free surrogate left (short telephone numbers), a value gets its kind and 32
    digits of its keyed hash.
    """
    open_ = materialize(values.withColumn("draw", F.lit(0)))
    done: DataFrame | None = None
    for draw in range(MAX_DRAWS):
        ready = open_.withColumn("_at", F.lit(r"^(.*)(\.[^.]+)$")).withColumn("_h", _hex(key, F.col("kind"), F.col("canon"), F.lit(str(draw))))
        drawn = materialize(ready.withColumn("s", _drawn()).select("kind", "canon", "s"))
        # a value that really occurs is no surrogate, nor is one given before
        taken = values.select("kind", F.col("canon").alias("s"))
        taken = taken if done is None else taken.unionByName(done.select("kind", "s"))
        free = drawn.join(taken, ["kind", "s"], "left_anti")
        winner = free.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        won = materialize(winner.select("kind", "canon", "s"))
        done = won if done is None else done.unionByName(won)
        open_ = materialize(open_.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if open_.isEmpty():
            return done.withColumnRenamed("s", "surrogate")
    rest = open_.select("kind", "canon", F.concat_ws("-", "kind", F.substring(_hex(key, F.col("kind"), F.col("canon"), F.lit("rest")), 1, 32)).alias("s"))
    return done.unionByName(rest).withColumnRenamed("s", "surrogate")


def _written(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the place: its digits fill the place's last digits, and so on.

    Digits in front of those that a telephone number's surrogate has say the country, and stay. Of a name
    that is given by its last part, only that is written.
    """
    drawn = "regexp_replace(surrogate, '[^0-9]', '')"
    spare = f"length(regexp_replace(value, '[^0-9]', '')) - length({drawn})"
    nth = "length(regexp_replace(substr(value, 1, i + 1), '[^0-9]', ''))"
    digits = F.expr(
        f"array_join(transform(split(value, ''), (c, i) -> if(c rlike '[0-9]' and {nth} > {spare}, substr({drawn}, {nth} - ({spare}), 1), c)), '')"
    )
    letters = F.expr(
        "array_join(transform(split(value, ''), (c, i) -> if(c = ' ', c, "
        "substr(surrogate, length(regexp_replace(substr(value, 1, i + 1), ' ', '')), 1))), '')"
    )
    upper = (value == F.upper(value)) & (value != F.lower(value))
    words = F.regexp_replace(surrogate, r"^\S+ ", "")
    words = F.when(_bare(value).rlike(r"\s"), words).otherwise(F.substring_index(words, " ", -1))
    titled = F.concat(F.regexp_extract(value, f"^{TITLES}", 0), F.initcap(words))
    return (
        F.when(surrogate.startswith(F.concat(kind, F.lit("-"))), surrogate)
        .when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "iban", letters)
        .when(kind == "email", F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "name", F.when(upper, F.upper(titled)).otherwise(titled))
        .otherwise(surrogate)
    )


def replace(docs: DataFrame, key: str = "doc_id", text: str = "text", *, secret: str) -> DataFrame:
    """key, text with every entity replaced, n_entities long and kinds (sorted, comma-joined)."""
    base = docs.select(F.col(key), F.col(text).alias("text"))
    found = base.select(F.col(key).alias("k"), F.xxhash64("text").alias("t"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("i", "value"))
    # a long number is a card's only if its checksum holds, and so with an IBAN; others stay
    card = F.call_function("luhn_check", F.regexp_replace("value", "[^0-9]", ""))
    account = F.expr(_MOD97.format(v="replace(value, ' ', '')")) == 1
    kind = F.col("kind")
    found = found.withColumn("kind", _kind(F.col("value"))).withColumn("kind", F.when((kind == "card") & ~card, None).when((kind == "iban") & ~account, None).otherwise(kind))
    found = found.withColumn("canon", _canonical(F.col("kind"), F.col("value"))).withColumn("d", F.xxhash64("k", "t"))
    found = _linked(materialize(found.distinct()))
    given = surrogates(found.where("kind is not null").select("kind", "canon").distinct(), secret)
    named = found.join(given, ["kind", "canon"], "left")
    written = named.select("k", "t", "i", "kind", F.coalesce(_written(F.col("kind"), F.col("value"), F.col("surrogate")), F.col("value")).alias("w"), *_keys())
    listed = written.groupBy("k", "t").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count("kind").alias("n"),
        F.sort_array(F.flatten(F.collect_set("known"))).alias("known"),
    )
    # of several names with one surname, the first in order is meant by the surname alone
    first = F.filter("known", lambda x, i: (i == 0) | (F.get("known", i - 1)["of"] != x["of"]))
    listed = listed.withColumn("known", F.map_from_arrays(F.transform(first, lambda x: x["of"]), F.transform(first, lambda x: x["s"])))
    out = base.withColumn("_t", F.xxhash64("text")).join(listed, F.col(key).eqNullSafe(F.col("k")) & (F.col("_t") == F.col("t")), "left")
    parts = F.split("text", ANY, -1)
    parts = F.when(F.size("known") > 0, F.transform(parts, _untitled)).otherwise(parts)
    filled = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get("words", i), F.lit("")))), "")
    return out.select(
        key, F.when(F.col("words").isNull(), F.col("text")).otherwise(filled).alias("text"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce("kinds", F.lit("")).alias("kinds"),
    )


def _linked(found: DataFrame) -> DataFrame:
    """found with the values of names that go with another name of the same text."""
    last = F.substring_index("canon", " ", -1)
    peers = found.where("kind = 'name'").groupBy("d", last.alias("last")).agg(F.sort_array(F.collect_set("canon")).alias("peers"))
    fits = "(left(canon, 1) = 'n' or left(x, 1) in (left(canon, 1), 'n'))"
    full = f"array_min(filter(peers, x -> size(split(x, ' ')) = 3 and {fits}))"
    same = "array_min(filter(peers, x -> substr(x, 3) = substr(canon, 3)))"
    to = F.expr(f"case when kind <> 'name' then canon when size(split(canon, ' ')) = 2 then coalesce({full}, if(canon like 'n %', {same}, canon)) when canon like 'n %' then {same} else canon end")
    own = found.withColumn("last", F.when(F.col("kind") == "name", last)).join(peers, ["d", "last"], "left")
    return own.withColumn("canon", to).drop("d", "last", "peers")


def _keys() -> list[Column]:
    """known: what words without a title stand for this name (null for other entities): its full form and its surname."""
    one = lambda of: F.struct(of.alias("of"), F.col("canon").alias("c"), F.regexp_replace("surrogate", r"^\S+ ", "").alias("s"))
    return [F.when((F.col("kind") == "name") & ~F.col("surrogate").startswith("name-"), F.array(one(F.expr("substr(canon, 3)")), one(F.substring_index("canon", " ", -1)))).alias("known")]


def _untitled(part: Column) -> Column:
    """A stretch of text between entities, with the words of the text's names replaced."""
    pattern = rf"(?<![\p{{L}}\p{{N}}]){WORD}"
    words, gaps = F.regexp_extract_all(part, F.lit(pattern), F.lit(0)), F.split(part, pattern, -1)

    def pair(i: Column) -> Column:
        """The surrogate of the words i and i + 1, if they are a name."""
        near = (i >= 0) & F.get(gaps, i + 1).rlike(r"^\s$")
        return F.when(near, F.try_element_at("known", F.lower(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))))

    def new(word: Column, i: Column) -> Column:
        of = F.coalesce(F.substring_index(pair(i), " ", 1), F.substring_index(pair(i - 1), " ", -1), F.substring_index(F.try_element_at("known", F.lower(word)), " ", -1))
        return F.concat(F.get(gaps, i), F.coalesce(F.when(word == F.upper(word), F.upper(of)).otherwise(F.initcap(of)), word))

    return F.concat(F.array_join(F.transform(words, new), ""), F.get(gaps, F.size(words)))
