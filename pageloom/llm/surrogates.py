"""PII surrogates: keyed, type-consistent replacements of detected entities.

Detected are e-mail addresses, IBANs, payment card numbers, IPv4 addresses,
social security numbers, phone numbers, secrets in assignments and names after a
title. A surrogate has its entity's type, format (length, separators, prefix, check digits),
script and, for names, gender of the title.

An entity is what its spellings have in common (its canonical form: separators, and in addresses case, do not count),
so it has one surrogate in all documents (coreference). Numbers, secrets and the local parts of addresses are mapped
by a keyed permutation of all strings of their layout, so distinct entities keep distinct surrogates in any number; an
image that is itself a real entity, or taken, is replaced by that under another permutation. Card numbers
keep two leading digits, phone numbers their country, IBANs theirs; check digits that were right are right again.
Names are mapped by their parts: a family name has one surrogate beside every given name and every title. A part's
surrogate is drawn from names and syllables by SHA-256 of the key, and drawn again, longer, where another part draws it or has it.

Only DataFrame functions. Defined cases: null and empty texts pass unchanged with no
entities, an empty table gives no rows; detection is leftmost, in the order above; repeated rows get equal
results; texts of any length are searched whole; columns named as the results are replaced, others stay. A secret
has a letter or digit; a run of signs alone, as a form's blank line, is none. An entity whose images are all real or
taken in ``MOST_ROUNDS`` permutations, as of a layout with very few strings, gets ``X`` and its own digest, and so
does a part of a name whose ``ATTEMPTS`` draws all collide. A name without a title is not detected by itself, but a
given and family name detected in a text is replaced wherever that text repeats them (this is not counted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.llm.common import row_key, write_shared

ATTEMPTS = 6
MOST_ROUNDS = 8
DEFAULT_KEY = "change-this-key"

#: Given names by script and gender. Fixed values.
NAMES = {
    ("latin", "f"): ("Anna", "Clara", "Diane", "Elena", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nina", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Yvonne"),
    ("latin", "m"): ("Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Lukas", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "n"): ("Alex", "Andrea", "Charlie", "Dana", "Eli", "Jamie", "Jules", "Kim", "Lee", "Luca", "Morgan", "Noa", "Robin", "Sam", "Sasha", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Павел", "Роман"),
    ("cyrillic", "n"): ("Женя", "Саша", "Валя", "Слава", "Паша", "Тоня", "Шура", "Митя"),
}
#: Syllables and endings of family names by script. Fixed values.
SYLLABLES = {
    "latin": ("ba", "bel", "cor", "da", "del", "en", "fal", "gar", "hal", "is", "jor", "ka", "lin", "mar", "nor", "ol", "par", "quin", "ra", "sel", "tan", "ul", "ver", "wen"),
    "cyrillic": ("ба", "бел", "вор", "да", "дор", "ер", "жу", "зим", "иль", "ка", "лан", "мор", "нов", "ор", "пет", "ра", "сел", "тар", "фад", "ход"),
}
ENDINGS = {"latin": ("berg", "field", "ford", "ley", "man", "sen", "stein", "wood"), "cyrillic": ("ев", "енко", "ин", "ко", "ов", "ский", "ук", "ян")}
#: Titles that announce a name, by gender. Fixed values.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Sra", "Señora", "Госпожа"), "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин"), "n": ("Dr", "Prof")}

_TITLE = "|".join(t for g in ("f", "m", "n") for t in TITLES[g])
_ASSIGNED = r"(?i:token|secret|passwd|password|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
_TITLED = rf"(?<!\p{{L}})(?:{_TITLE})\.? "
#: (type, what stays in front, entity). Earlier ones win at the same place.
PATTERNS = (
    ("email", "", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"),
    ("secret", _ASSIGNED, r"(?=[_\-/+]{0,127}[A-Za-z0-9])[A-Za-z0-9_\-/+]{12,128}"),
    ("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", "", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{13})(?![0-9])"),
    ("ip", "", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", "", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("name", _TITLED, r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})"),
)
COMBINED = "|".join(f"(?:{front}{entity})" for _, front, entity in PATTERNS)
#: No entity is without one of these; most texts need no more than this search.
HINT = rf"@|[0-9][0-9]|[0-9]\.[0-9]|(?i:token|secret|passw|api_?key)|(?:{_TITLE})\.? \p{{Lu}}"


def _kind(span: Column) -> Column:
    """Type of a detected span: the first pattern that it is."""
    chain = None
    for kind, front, entity in PATTERNS:
        bare = entity.replace("(?<![A-Za-z0-9])", "").replace("(?<![0-9])", "").replace("(?<![0-9.])", "").replace("(?<![0-9-])", "").replace("(?<![0-9A-Za-z+])", "")
        test = span.rlike(rf"\A(?:{front}{bare})\z")
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("secret")


def _front(span: Column, kind: Column) -> Column:
    """What of a span stays: the assignment of a secret, the title of a name."""
    return (
        F.when(kind == "secret", F.regexp_extract(span, rf"\A{_ASSIGNED}", 0))
        .when(kind == "name", F.regexp_extract(span, rf"\A(?:{_TITLE})\.? ", 0))
        .otherwise("")
    )


def _gender(front: Column) -> Column:
    title = F.regexp_extract(front, r"\A\p{L}+", 0)
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two spellings one entity: separators and, in addresses, case do not count."""
    bare = F.regexp_replace(entity, r"[ .()\-]", "")
    return F.when(kind.isin("phone", "card", "iban", "ssn"), bare).when(kind == "email", F.lower(entity)).otherwise(entity)


def _pick(values: tuple[str, ...], digest: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.conv(F.substring(digest, at, 6), 16, 10).cast("int") % len(values) + 1).cast("int"))


def _shifted(c: Column, by: Column) -> Column:
    """A digit or Latin letter moved on within its own alphabet; anything else as it is."""
    code = F.ascii(c)
    moved = lambda first, size: F.char(first + F.pmod(code - first + by, F.lit(size)))
    return F.when(c.rlike("[0-9]"), moved(48, 10)).when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26)).otherwise(c)


def permuted(s: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the strings of one layout (digits, small and capital letters keep their places).

    Each character is moved on by the hash of those before it, then each by the hash of those after it: either
    pass can be undone from its own end, so no two strings have one image, and every place depends on all.
    """
    forward = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c, i: _shifted(c, F.pmod(F.xxhash64(F.lit(key), tweak, F.lit(1), i, F.substring(t, F.lit(1), i)), F.lit(260)).cast("int"))), "")
    backward = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c, i: _shifted(c, F.pmod(F.xxhash64(F.lit(key), tweak, F.lit(2), i, F.substring(t, i + 2, F.length(t))), F.lit(260)).cast("int"))), "")
    return F.when(s == "", s).otherwise(let(s, lambda t: let(forward(t), backward)))


def _luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` and it a valid card number."""
    back = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(back, F.lit(0), lambda n, x: n + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def _mod_97(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN, as a number."""
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    value = lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)
    return F.lit(98) - F.aggregate(chars, F.lit(0), value)


def _ip(entity: Column, key: str) -> Column:
    """A keyed permutation of the IPv4 addresses: four rounds that add a hash of one half to the other."""
    part = lambda k: F.element_at(F.split(entity, r"\."), k).cast("int")
    start = F.struct((part(1) * 256 + part(2)).cast("int").alias("a"), (part(3) * 256 + part(4)).cast("int").alias("b"))
    turn = lambda x, k: F.struct(x["b"].alias("a"), F.pmod(x["a"] + F.xxhash64(F.lit(key), k, x["b"]), F.lit(65536)).cast("int").alias("b"))
    mixed = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn)
    return let(mixed, lambda x: F.concat_ws(".", *[f.cast("string") for f in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)]))


def image(kind: Column, canon: Column, key: str = DEFAULT_KEY) -> Column:
    """The surrogate of a canonical form of any type but names, in canonical form too."""
    text = lambda a, n=None: F.substring(canon, F.lit(a), F.lit(n)) if n else F.substring(canon, F.lit(a), F.length(canon))
    country = F.when(~canon.startswith("+"), 0).when(F.substring(canon, 2, 1).isin("1", "7"), 2).otherwise(3)
    phone = F.concat(F.substring(canon, F.lit(1), country), permuted(F.substring(canon, country + 1, F.length(canon)), F.concat(F.lit("phone"), F.substring(canon, F.lit(1), country)), key))
    middle = F.substring(canon, F.lit(3), F.length(canon) - 3)
    # a check digit as far from the right one as the entity's: right stays right, and no two entities meet
    card = let(F.concat(text(1, 2), permuted(middle, F.concat(F.lit("card"), text(1, 2)), key)), lambda new: F.concat(new, F.pmod(_luhn(new) + F.substring(canon, -1, 1).cast("int") - _luhn(F.substring(canon, F.lit(1), F.length(canon) - 1)), F.lit(10)).cast("string")))
    iban = let(permuted(text(5), F.concat(F.lit("iban"), text(1, 2)), key), lambda new: F.concat(text(1, 2), F.lpad(F.pmod(_mod_97(text(1, 2), new) + text(3, 2).cast("int") - _mod_97(text(1, 2), text(5)), F.lit(100)).cast("string"), 2, "0"), new))
    local, domain = F.element_at(F.split(canon, "@"), 1), F.element_at(F.split(canon, "@"), -1)
    host = F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), domain), 256), 1, 16), F.lit(".example."), F.element_at(F.split(domain, r"\."), -1))
    return (
        F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", _ip(canon, key))
        .when(kind == "email", F.concat(permuted(local, F.concat(F.lit("email"), domain), key), F.lit("@"), host))
        .otherwise(permuted(canon, kind, key))
    )


def poured(kind: Column, entity: Column, drawn: Column) -> Column:
    """A canonical surrogate in the spelling of an entity: its letters and digits, the entity's separators."""
    rank = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^A-Za-z0-9]", ""))
    spelled = let(F.regexp_replace(drawn, "[^A-Za-z0-9]", ""), lambda d: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(d, rank(i) + 1, F.lit(1))).otherwise(c)), ""))
    return F.when(kind.isin("phone", "card", "iban", "ssn"), spelled).otherwise(drawn)


def drawn_part(kind: Column, part: Column, gender: Column, attempt: Column, key: str = DEFAULT_KEY) -> Column:
    """What ``attempt`` draws for a given or a family name: one more name, or one more syllable, each time."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, part, attempt.cast("string")), 256)
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = F.lit(None).cast("string")
    for (s, g), values in NAMES.items():
        own = F.concat_ws("-", *[F.when(attempt >= k, _pick(values, digest, 1 + 7 * k)) for k in range(ATTEMPTS)])
        given = F.when((script == s) & (gender == g), own).otherwise(given)
    family = F.lit(None).cast("string")
    for s, values in SYLLABLES.items():
        syllables = [F.when(attempt + 3 > k, _pick(values, digest, 1 + 6 * k)) for k in range(ATTEMPTS + 2)]
        own = F.concat(F.initcap(F.concat_ws("", *syllables)), _pick(ENDINGS[s], digest, 57))
        family = F.when(script == s, own).otherwise(family)
    return F.when(kind == "given", given).otherwise(family)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, place, kind, front, entity, gender) of every entity of every distinct text that has one."""
    texts = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike(HINT))
    spans = texts.select(row_key("t").alias("key"), F.regexp_extract_all(F.col("t"), F.lit(COMBINED), 0).alias("spans")).filter(F.size("spans") > 0)
    rows = spans.dropDuplicates(["key"]).select("key", F.posexplode("spans").alias("place", "span")).withColumn("kind", _kind(F.col("span")))
    rows = rows.withColumn("front", _front(F.col("span"), F.col("kind")))
    rows = rows.withColumn("entity", F.expr("substring(span, length(front) + 1)"))
    return rows.select("key", "place", "kind", "front", "entity", _gender(F.col("front")).alias("gender"))


def own_digest(kind: Column, entity: Column, key: str = DEFAULT_KEY) -> Column:
    """A surrogate of no layout, for entities that no permutation gives a free image."""
    return F.concat(F.lit("X"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("own"), kind, entity), 256), 1, 24))


def _named(found: DataFrame, key: str, attempts: int) -> DataFrame:
    """(entity, surrogate) of the names: by given and family name, each with one surrogate, no two parts with the same."""
    spelled = found.filter("kind = 'name'").groupBy("entity").agg(F.max((F.col("gender") == "f").cast("int")).alias("f"), F.max((F.col("gender") == "m").cast("int")).alias("m"))
    parts = F.split("entity", " ")
    spelled = spelled.withColumn("given", F.when(F.size(parts) > 1, F.element_at(parts, 1))).withColumn("family", F.element_at(parts, -1))
    spelled = write_shared(spelled, "names")
    each = spelled.select(F.lit("given").alias("part_kind"), F.col("given").alias("part"), "f", "m").filter("part IS NOT NULL")
    each = each.unionAll(spelled.select(F.lit("family"), "family", F.lit(0), F.lit(0)))
    each = each.groupBy("part_kind", "part").agg(F.max("f").alias("f"), F.max("m").alias("m"))
    each = each.withColumn("gender", F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n"))
    draws = each.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    draws = write_shared(draws.withColumn("drawn", drawn_part(F.col("part_kind"), F.col("part"), F.col("gender"), F.col("attempt"), key)), "name-draws")
    # the first draw that no other part makes in any attempt and that is no real part: no rounds are needed
    claims = draws.select("part_kind", "drawn", "part", "attempt", F.lit(0).alias("real")).unionAll(each.select("part_kind", F.col("part").alias("drawn"), "part", F.lit(0).alias("attempt"), F.lit(1).alias("real")))
    free = claims.groupBy("part_kind", "drawn").agg(F.max("real").alias("real"), F.min("part").alias("part"), F.max("part").alias("other"), F.min("attempt").alias("attempt"))
    first = free.filter((F.col("real") == 0) & (F.col("part") == F.col("other"))).groupBy("part_kind", "part").agg(F.min(F.struct("attempt", "drawn")).alias("best"))
    own = F.concat(F.col("part"), F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.col("part_kind"), F.col("part")), 256), 1, 24))
    own = F.regexp_replace(own, r"\A.*-", "X-")
    chosen = write_shared(each.join(first, ["part_kind", "part"], "left").select("part_kind", "part", F.coalesce("best.drawn", own).alias("drawn")), "name-parts")
    of = lambda kind: chosen.filter(F.col("part_kind") == kind).select(F.col("part").alias(kind), F.col("drawn").alias(f"new_{kind}"))
    both = spelled.join(of("family"), "family").join(of("given"), "given", "left")
    return both.select(F.lit("name").alias("kind"), "entity", F.concat_ws(" ", "new_given", "new_family").alias("surrogate"))


def assign(found: DataFrame, key: str = DEFAULT_KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, entity, surrogate): distinct entities of a type get distinct surrogates, none of them a real entity."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = found.filter("kind <> 'name'").select("kind", "entity").distinct().withColumn("canon", canonical(F.col("kind"), F.col("entity")))
    entities = write_shared(entities, "spellings")
    # few rows, much work on each: dealt evenly
    known = entities.select("kind", "canon").distinct().repartition(parts, "kind", "canon")
    known = write_shared(known.withColumn("drawn", image(F.col("kind"), F.col("canon"), key)), "images")
    # an image that is a real entity, or was taken before, is left to the next permutation: a small part each time
    taken = known.select(F.col("kind").alias("t_kind"), F.col("canon").alias("t_drawn"))
    mapped, waiting = None, known
    for attempt in range(1, MOST_ROUNDS + 1):
        met = (F.col("kind") == F.col("t_kind")) & (F.col("drawn") == F.col("t_drawn"))
        free = write_shared(waiting.join(taken, met, "left_anti"), "images-free") if mapped is not None else known.join(taken, met, "left_anti")
        waiting = waiting.join(taken, met, "left_semi").select("kind", "canon", image(F.col("kind"), F.col("canon"), f"{key}#{attempt}").alias("drawn"))
        mapped = free if mapped is None else mapped.unionAll(free)
        waiting = write_shared(waiting.distinct(), "images-waiting")
        if not waiting.limit(1).count():
            break
        taken = taken.unionAll(free.select("kind", "drawn"))
    spelled = F.when(F.col("drawn").isNotNull(), poured(F.col("kind"), F.col("entity"), F.col("drawn"))).otherwise(own_digest(F.col("kind"), F.col("canon"), key))
    plain = entities.join(mapped, ["kind", "canon"], "left").select("kind", "entity", spelled.alias("surrogate"))
    return plain.unionAll(_named(found, key, attempts))


def _without_names(piece: Column) -> Column:
    """What stands between entities, with the given and family names of ``_pii_names`` replaced; names hold letters and a blank only."""
    whole = lambda name: F.concat(F.lit(r"(?<!\p{L})"), name, F.lit(r"(?!\p{L})"))
    return F.aggregate("_pii_names", piece, lambda t, n: F.when(t.contains(n["entity"]), F.regexp_replace(t, whole(n["entity"]), n["surrogate"])).otherwise(t))


def replace_entities(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with surrogates in place of entities, and n_entities."""
    docs = docs.drop("n_entities")
    names = docs.columns
    found = write_shared(detect(docs, text), "entities")
    table = assign(found, key)
    # a left join: whatever has no surrogate keeps its place, so that no other replacement moves into it
    placed = found.join(table, ["kind", "entity"], "left").withColumn("surrogate", F.coalesce("surrogate", own_digest(F.col("kind"), F.col("entity"), key)))
    full_name = F.when((F.col("kind") == "name") & F.col("entity").contains(" "), F.struct("entity", "surrogate"))
    filled = (
        placed.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.concat("front", "surrogate").alias("new")))).alias("_pii_new"), F.array_sort(F.collect_set(full_name)).alias("_pii_names"))
        .withColumnRenamed("key", "_pii_key")
    )
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    plain = docs.filter(~hinted).select(*names, F.lit(0).alias("n_entities"))
    marked = docs.filter(hinted).withColumn("_pii_own", row_key(text)).join(filled, F.col("_pii_own") == F.col("_pii_key"), "left")
    pieces = F.transform(F.split(F.col(text), COMBINED, -1), lambda p: F.when(F.size("_pii_names") > 0, _without_names(p)).otherwise(p))
    rebuilt = F.array_join(F.zip_with(pieces, F.transform("_pii_new", lambda x: x["new"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    marked = marked.withColumn(text, F.when(F.col("_pii_new").isNull(), F.col(text)).otherwise(rebuilt)).withColumn("n_entities", F.coalesce(F.size("_pii_new"), F.lit(0)))
    marked = marked.withColumn("n_entities", F.when(F.col("_pii_new").isNull(), 0).otherwise(F.col("n_entities")))
    return plain.unionByName(marked.select(*names, "n_entities"))
