"""Personal data and secrets become keyed surrogates of the same type, format, script and gender, one for one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import free_name, stored

# First names by gender and last names, in Latin and in Cyrillic script.
NAMES = {
    "latin_f": "Ada Alma Bella Carla Clara Dora Edith Ella Elsa Emma Flora Greta Hanna Helen Ida Irene Jana Judith Karla Laura Lena Lydia Maria Marta Nina Nora Olga Paula Rita Rosa Ruth Sara Sofia Tessa Vera Wanda",
    "latin_m": "Adam Alan Anton Bruno Carl David Edgar Emil Erik Felix Frank Georg Hans Hugo Igor Ivan Jakob Jonas Karl Klaus Leo Louis Marco Martin Max Nils Oskar Otto Paul Peter Ralf Robert Simon Theo Viktor Walter",
    "latin_last": "Abel Adler Albers Arnold Bauer Becker Berg Blum Brandt Conrad Dahl Decker Eder Engel Falk Fischer Frey Gruber Haas Hahn Heller Hofer Jansen Keller Kern Koch Lang Lehmann Lorenz Maurer Meyer Nagel Neumann Ott Pfeiffer Roth Sander Seidel Stein Vogel Wagner Weber Winter Ziegler",
    "cyrillic_f": "Анна Вера Дарья Елена Зоя Ирина Лариса Майя Мария Нина Ольга Раиса Софья Тамара Юлия Яна",
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Юрий",
    "cyrillic_last_f": "Белова Волкова Громова Егорова Жукова Зайцева Козлова Лебедева Морозова Новикова Орлова Павлова Соколова Титова",
    "cyrillic_last_m": "Белов Волков Громов Егоров Жуков Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Титов",
}
# Forms of address that show a person's gender; the name follows.
FEMALE = "Mrs Ms Miss Frau Mme Madame Señora Sra Signora г-жа госпожа"
MALE = "Mr Herr Monsieur Señor Sr Signor г-н господин"

_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join((FEMALE + " " + MALE).split())
#: Type -> pattern, in the order in which they are tried at a place.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+\p{L}-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|xox[bap])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # after an area code; unseparated after a plus; in groups of two; ten digits without separators
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}[ .-]?[0-9]{6,12}|\+[0-9]{1,3}[ .-][0-9]{1,3}(?:[ .-][0-9]{2}){3,5}|0[1-9](?:[ .-][0-9]{2}){4}|(?:0[1-9]|[2-9][0-9])[0-9]{8})(?![0-9A-Za-z])",
    "name": rf"(?<=\b(?:{_TITLE})\.?[ \x09])(?:{_WORD})(?: {_WORD})?",
}


#: Every entity holds, or follows, one of these.
MARKS = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|(?<![A-Za-z0-9])(?:(?:sk|pk|ghp|gho|xox[bap])[-_]|AKIA)|\b(?:{_TITLE})\.?[ \x09]\p{{Lu}}"


@dataclass(frozen=True)
class Settings:
    """`key` makes the surrogates: the same key gives the same ones, another key others. Kept outside the data."""

    key: str = "a key of your own"
    #: Rounds of proposals; where entities of one format are more than its surrogates, replace() fails after them.
    attempts: int = 40


DEFAULT = Settings()


def _pattern() -> str:
    """One pattern for all types; emails and secrets first, as digits inside them are no numbers of their own."""
    names = TYPES["name"]
    return "|".join([*(v for k, v in TYPES.items() if k != "name"), names])


def _kind(entity: Column) -> Column:
    kind = F.lit("name")
    for k in ("phone", "ssn", "card", "ip", "iban", "secret", "email"):
        body = TYPES[k]
        kind = F.when(entity.rlike(f"^(?:{body})$"), k).otherwise(kind)
    return kind


def _canonical(kind: Column, entity: Column) -> Column:
    """What different spellings of one entity have in common, so that they get one surrogate. Secrets have one spelling."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("phone", "ssn", "card"), digits).when(kind.isin("ip", "secret"), entity).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "name", F.initcap(F.lower(entity))).otherwise(F.lower(entity))


def _bare(kind: Column, canonical: Column) -> Column:
    """Names carry their gender before a colon: two persons of one name and two genders are two entities."""
    return F.when(kind == "name", F.substring_index(canonical, ":", -1)).otherwise(canonical)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _alike(source: Column, hexes: Column, at: int = 0) -> Column:
    """Pseudo-random text of the same alphabet: digits for digits, small and capital letters for such, all else as it is."""

    def one(c: Column, i: Column) -> Column:
        x = F.substring(hexes, (F.pmod(i + at, F.lit(128)) + 1).cast("int"), F.lit(1))
        letter = F.translate(x, "0123456789", "ghijklmnop")
        return F.when(c.between("0", "9"), F.translate(x, "abcdef", "024689")).when(c.between("A", "Z"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(source), one), "")


def _mod97(c: Column) -> Column:
    """The remainder of an IBAN's characters, letters counting as 10 to 35."""
    step = lambda a, x: F.when(x.between("0", "9"), F.pmod(a * 10 + x.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(x) - 55, F.lit(97)))
    return F.aggregate(_chars(c), F.lit(0), step)


def _digits_of(hexes: Column) -> Column:
    """128 pseudo-random decimal digits from 128 hexadecimal ones, each from two of a doubled hash."""
    return F.translate(hexes, "abcdef", "024689")


def _luhn(digits: Column) -> Column:
    """The sum of a card number's digits, every second from the right doubled; it ends in 0 if the number is valid."""
    d = F.reverse(_chars(digits))
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.cast("int") + 1))
    return F.aggregate(F.transform(d, value), F.lit(0), lambda a, x: a + x)


def _pick(pool: str, number: Column) -> Column:
    names = NAMES[pool].split()
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def _surrogate(s: Settings) -> Column:
    """Canonical surrogate of columns kind, canonical, tried and h, their keyed hash."""
    h = F.col("h")
    n = F.length("canonical")
    digits = _digits_of(h)
    number = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    octet = lambda a, lo, span: (F.pmod(number(a), F.lit(span)) + lo).cast("string")
    # the last digit of a card keeps the number valid, or invalid, as it was
    body = F.concat(F.substring("canonical", 1, 1), F.substring(digits, F.lit(2), n - 2))
    short = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(_luhn(F.col("canonical")), F.lit(10)) == 0
    card = F.concat(body, F.pmod(short + F.when(valid, 0).otherwise(1 + F.pmod(number(100), F.lit(9))), F.lit(10)).cast("string"))
    # a phone of more than ten digits starts with a country code of one to three
    code = F.when(n <= 10, 0).when(F.col("canonical").rlike("^[17]"), 1).when(F.col("canonical").rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)
    phone = F.concat(F.substring("canonical", F.lit(1), code), F.substring(F.lit("2345678923456789"), (F.pmod(number(1), F.lit(8)) + 1).cast("int"), F.lit(1)), F.substring(digits, F.lit(2), n - code - 1))
    cyrillic = F.col("canonical").rlike(r"\p{IsCyrillic}")
    female = F.col("canonical").startswith("f:")
    two = F.col("canonical").contains(" ")
    latin_first = F.when(female, _pick("latin_f", number(1))).otherwise(_pick("latin_m", number(1)))
    cyr_first = F.when(female, _pick("cyrillic_f", number(1))).otherwise(_pick("cyrillic_m", number(1)))
    cyr_last = F.when(female, _pick("cyrillic_last_f", number(9))).otherwise(_pick("cyrillic_last_m", number(9)))
    # beyond the first attempts a number of letters is added to the last name, so that names never run out
    more = F.when(F.col("tried") > 1, F.concat(F.lit("-"), F.initcap(F.translate(F.substring(h, 20, 6), "0123456789", "ghijklmnop")))).otherwise(F.lit(""))
    last = F.concat(F.when(cyrillic, cyr_last).otherwise(_pick("latin_last", number(9))), F.when(cyrillic, F.translate(F.lower(more), "abcdefghijklmnop", "авекмнорстуиласд")).otherwise(more))
    name = F.when(two, F.concat(F.when(cyrillic, cyr_first).otherwise(latin_first), F.lit(" "), last)).otherwise(last)
    # local part and host names in their own alphabets under a reserved domain; more letters if these don't suffice
    local, host = F.substring_index("canonical", "@", 1), F.regexp_extract("canonical", r"@(.*)\.", 1)
    letters = F.when(F.col("tried") > 1, F.translate(F.substring(h, 90, 8), "0123456789", "ghijklmnop")).otherwise(F.lit(""))
    email = F.concat(_alike(local, h), letters, F.lit("@"), _alike(host, h, 64), F.lit(".example"))
    lead = F.regexp_extract("canonical", "^((?:sk|pk|ghp|gho|xox[bap])[-_]|AKIA)?", 1)
    long_hex = F.substring(F.repeat(h, 2), F.lit(1), n)
    secret = F.when(F.col("canonical").rlike("^[0-9a-f]+$"), long_hex).when(F.col("canonical").rlike("^[0-9A-F]+$"), F.upper(long_hex)).otherwise(F.concat(lead, _alike(F.expr("substring(canonical, 1 + length(regexp_extract(canonical, '^((?:sk|pk|ghp|gho|xox[bap])[-_]|AKIA)?', 1)))"), h)))
    # the check digits of an IBAN keep it valid, or invalid, as it was
    country, account = F.substring("canonical", 1, 2), _alike(F.substring("canonical", F.lit(5), n), h)
    right = _mod97(F.concat(F.expr("substring(canonical, 5)"), F.substring("canonical", 1, 4))) == 1
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    iban = F.concat(country, F.lpad(F.when(right, check).otherwise(2 + F.pmod(check - 1, F.lit(97))).cast("string"), 2, "0"), account)
    return (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "secret", secret)
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "ip", F.concat_ws(".", octet(1, 240, 15), octet(9, 0, 256), octet(17, 0, 256), octet(25, 1, 254)))
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "phone", phone)
        .when(F.col("kind") == "ssn", F.concat(F.lit("9"), F.substring(digits, 2, 8)))
        .otherwise(name)
    )


def _dressed(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the format of this spelling: its separators, its capitals."""
    chars = _chars(entity)
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a.s, F.substring(surrogate, a.i, F.lit(1))).alias("s"), (a.i + 1).alias("i"))).otherwise(F.struct(F.concat(a.s, c).alias("s"), a.i.alias("i")))
    laid = F.aggregate(chars, start, step, lambda a: a.s)
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    return F.when(kind.isin("phone", "ssn", "card", "iban"), laid).when(kind.isin("email", "name") & upper, F.upper(surrogate)).otherwise(surrogate)


def dictionary(entities: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical): keyed, distinct, and never an entity of the data.

    Each round proposes surrogates by hash, and settles those that no other entity of the kind proposes or has, and that
    are no entity themselves; of several that propose one, the least entity gets it. The rest try again, so the rounds needed
    grow with the share of a format's surrogates that is in use; after `attempts` rounds an error says that they don't suffice.
    """
    todo = stored(entities.select("kind", "canonical").distinct())
    real = todo.select(F.col("kind").alias("rk"), _bare(F.col("kind"), F.col("canonical")).alias("rc")).distinct()
    done = None
    for tried in range(1, s.attempts + 1):
        p = todo.withColumn("tried", F.lit(tried)).withColumn("h", F.sha2(F.concat_ws("|", F.lit(s.key), "kind", "canonical", F.lit(str(tried))), 512))
        p = stored(p.withColumn("surrogate", _surrogate(s)).select("kind", "canonical", "surrogate"))
        # the spelling that would be compared: names and secrets as canonical() writes them
        free = p.join(real, (F.col("kind") == F.col("rk")) & (_canonical(F.col("kind"), F.col("surrogate")) == F.col("rc")), "left_anti")
        if done is not None:
            free = free.join(done.select(F.col("kind").alias("dk"), F.col("surrogate").alias("ds")), (F.col("kind") == F.col("dk")) & (F.col("surrogate") == F.col("ds")), "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"))
        done = won if done is None else done.unionByName(won)
        todo = stored(p.join(won.select(F.col("kind").alias("wk"), F.col("canonical").alias("wc")), (F.col("kind") == F.col("wk")) & (F.col("canonical") == F.col("wc")), "left_anti").drop("surrogate"))
        if not todo.limit(1).count():
            return done
    raise ValueError(f"some entities have no free surrogate of their format after {s.attempts} rounds")


def _people(text: Column) -> Column:
    """Persons that a text names after a form of address: spelling, canonical name with gender, last name."""
    titled = rf"\b({_TITLE})\.?[ \x09]({_WORD}(?: {_WORD})?)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(titled), 1).alias("title"), F.regexp_extract_all(text, F.lit(titled), 2).alias("name"))
    one = lambda p: F.struct(p["name"].alias("name"), F.concat(F.when(p["title"].isin(*FEMALE.split()), "f:").otherwise("m:"), _canonical(F.lit("name"), p["name"])).alias("canonical"), F.initcap(F.lower(F.substring_index(p["name"], " ", -1))).alias("last"))
    return F.array_distinct(F.transform(both, one))


def replace(docs: DataFrame, text: str = "text", s: Settings = DEFAULT) -> DataFrame:
    """docs with every entity in `text` replaced, and columns `entities` (how many) and `kinds` (type -> how many), with an
    underscore behind the name where docs has such a column.

    An entity, in whatever document and spelling, has one surrogate under a key (coreference), and two entities never share
    one (distinctness). Numbers keep their separators and count of digits, cards and IBANs their validity, phones their country
    code, secrets and e-mails their alphabet and separators, secrets their length, names their script and the gender that their
    form of address shows; text in capitals stays so. A name that a text has after a form of address is found in the rest of
    the text too, in full or by its last name; the last name of one who is named in full (the first such of the gender, or of
    all without a form of address) is that of the full name's surrogate. Only documents with entities, and of them only
    entities, are joined.

    Null text stays null with 0 entities; empty text and text without entities are unchanged. Repeated rows are all replaced
    alike. Other columns are kept as they are, whatever their names; an empty table stays empty.
    """
    columns, pattern = docs.columns, _pattern()
    n_entities, n_kinds = free_name("entities", columns), free_name("kinds", columns)
    # what every entity has is looked for first: most texts have none of it, and need no full search
    hit = F.coalesce(F.col(text).rlike(MARKS) & F.col(text).rlike(pattern), F.lit(False))
    none = F.create_map().cast("map<string,int>")
    clean = docs.filter(~hit).select(*columns, F.lit(0).alias(n_entities), none.alias(n_kinds))
    some = docs.filter(hit).select(F.struct(*columns).alias("doc"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    some = some.withColumn("people", _people(F.col("t")))
    spellings = F.array_distinct(F.concat(F.transform("people", lambda p: p["name"]), F.transform("people", lambda p: F.substring_index(p["name"], " ", -1))))
    longest_first = F.array_sort(spellings, lambda a, b: F.length(b) - F.length(a))
    again = F.concat(F.lit(pattern + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(longest_first, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    some = some.withColumn("pattern", F.when(F.size("people") > 0, again).otherwise(F.lit(pattern)))
    some = stored(some.withColumn("found", F.expr("regexp_extract_all(t, pattern, 0)")).withColumn("between", F.expr("split(t, pattern, -1)")).drop("t", "pattern"))
    each = some.select("row", "people", F.posexplode("found").alias("at", "entity"), F.col("between").alias("b"))
    title = F.regexp_extract(F.element_at("b", F.col("at") + 1), r"(\S+?)\.?[ \x09]$", 1)
    gender = F.when(title.isin(*FEMALE.split()), "f:").when(title.isin(*MALE.split()), "m:")
    each = each.withColumn("kind", _kind(F.col("entity"))).withColumn("gender", gender).withColumn("said", _canonical(F.col("kind"), F.col("entity")))
    fits = lambda p: F.coalesce(p["canonical"].startswith(F.col("gender")), F.lit(True))
    whole = F.get(F.filter("people", lambda p: fits(p) & (F.substring_index(p["canonical"], ":", -1) == F.col("said")) & F.contains("said", F.lit(" "))), F.lit(0))
    by_last = F.get(F.filter("people", lambda p: fits(p) & (p["last"] == F.col("said")) & F.contains(p["canonical"], F.lit(" "))), F.lit(0))
    alone = F.get(F.filter("people", lambda p: fits(p) & (F.substring_index(p["canonical"], ":", -1) == F.col("said"))), F.lit(0))
    person = F.coalesce(whole["canonical"], by_last["canonical"], alone["canonical"], F.concat(F.coalesce("gender", F.lit("m:")), F.col("said")))
    is_name = F.col("kind") == "name"
    each = each.select("row", "at", "entity", "kind", F.when(is_name, person).otherwise(F.col("said")).alias("canonical"), F.coalesce(is_name & whole["canonical"].isNull() & by_last["canonical"].isNotNull(), F.lit(False)).alias("short"))
    each = stored(each)
    names = dictionary(each, s)
    spelt = each.select("kind", "canonical", "entity", "short").distinct().join(names, ["kind", "canonical"])
    full = F.when(F.col("short"), F.substring_index("surrogate", " ", -1)).otherwise(F.col("surrogate"))
    spelt = spelt.select(F.col("kind").alias("k"), F.col("canonical").alias("c"), F.col("entity").alias("e"), F.col("short").alias("s"), _dressed(F.col("kind"), F.col("entity"), full).alias("new"))
    new = each.join(spelt, (F.col("kind") == F.col("k")) & (F.col("canonical") == F.col("c")) & (F.col("entity") == F.col("e")) & (F.col("short") == F.col("s")))
    new = new.groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("new"))
    joined = some.join(new, F.col("row") == F.col("r"))
    pairs = F.zip_with("between", F.col("new.new"), lambda b, n: F.concat(F.coalesce(b, F.lit("")), F.coalesce(n, F.lit(""))))
    kinds = F.map_from_entries(F.transform(F.array_distinct("new.kind"), lambda k: F.struct(k, F.size(F.filter("new.kind", lambda x: x == k)))))
    kept = [F.array_join(pairs, "").alias(text) if c == text else F.col("doc").getField(c).alias(c) for c in columns]
    return clean.unionByName(joined.select(*kept, F.size("new").alias(n_entities), kinds.alias(n_kinds)))
