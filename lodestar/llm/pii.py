"""Personal data: surrogate generation in DataFrame functions alone.

Detection: one alternation of patterns (``PATTERNS``) marks the mentions of a text in a single pass; what it finds is written to the shared
folder, and nothing is searched twice. A mention's type follows from its shape, and its canonical form (``body``: without format and case; for
phones the digits after the country code) says which entity it names, so mentions of one entity in different spellings stay together.
A name is found by its title. Its parts are entities of their own, so a surname alone keeps the surrogate that it has in full names, and
parts of a titled name are also found where they stand without a title in the same text.

Surrogates: a keyed digest of type, body and attempt gives a replacement body of the same shape: digits for digits, letters of the same
script and case, names built from syllables with an ending that fits the gender of their titles, octets in range and of equal width,
card numbers with their first digit and a valid check digit, IBANs with their country and valid check digits, phones with their country
code. The replacement is written back into the mention's own format and case.

Collisions: over all entities of the table, a surrogate must differ from the surrogate of any other entity and from any entity found in
the texts. Of entities that draw the same one, the first (by attempt, then body) keeps it; the others try ``at_once`` further attempts in
each round, until none is left. From attempt 4 on surrogates may leave the width of their shape (longer users, names and numbers, octets
of any width, and octets over 255 from attempt 12 on), so a shape with fewer values than entities can't keep a round from ending.

Scale: documents are never shuffled on the main path, only distinct entities (combined before the shuffle), so a hot entity is one row for each
task. Surrogates are drawn where a mention stands, from the key and the entity alone. Exceptions (entities that needed another attempt, and names
whose gender differs from what their own text says) are joined to the texts that mention them: by broadcast up to ``most_broadcast`` bytes, else by row.

Defined results: null text stays null, with no entities; texts without mentions stay as they are; a null doc_id stays null and
is replaced like any other; equal rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize

# Titles by gender, as they stand before a name.
MALE = "Mr Sir Herr Señor Monsieur Signor господин Господин Κύριος".split()
FEMALE = "Mrs Ms Miss Lady Frau Señora Señorita Madame Mademoiselle Signora госпожа Госпожа Κυρία".split()
NEUTRAL = "Dr Prof Doctor Professor".split()
_ALL_TITLES = [t for known in (MALE, FEMALE, NEUTRAL) for t in dict.fromkeys([*known, *(x.upper() for x in known)])]
_TITLES = "|".join(_ALL_TITLES)
_PART = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]*)*"
_INITIALS = r"(?:\p{Lu}\.)+"
_FULL = rf"(?:{_INITIALS} ){{0,3}}{_PART}(?: (?:{_INITIALS} ){{0,3}}{_PART}){{0,2}}"
_KEYWORD = r"(?i:password|passwd|token|secret|api_key)"
_USER = "[A-Za-z0-9._%+-]"
# Country calling codes of one and two digits; all others have three.
_CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

#: Types in the order in which they are tried at a place. An address of e-mail is only tried where its first part can begin.
PATTERNS = {
    "email": rf"(?:(?<!{_USER})|\G){_USER}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[{''.join(sorted({t[0] for t in _ALL_TITLES}))}])(?:{_TITLES})\.? {_FULL}",
    "secret": rf"AKIA[0-9A-Z]{{16}}|{_KEYWORD}\s?[=:]\s?\"?[A-Za-z0-9]{{12,}}\"?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\d.]\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?!\d)",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|\+(?=(?:[ .()/-]{0,2}\d){8,13}(?!\d))\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,6}(?!\d)|\+\d{8,15}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_TITLE = rf"^(?:{_TITLES})\.? "
_SECRET_HEAD = rf"^(AKIA|{_KEYWORD}\s?[=:]\s?\"?)"
#: A character that no text should hold; texts that do are marked by it and a digest of their own.
_MARK = "\ufdd0"
_ONSETS = {"latin": "b c d f g h k l m n p r s t v w".split(), "cyrillic": "б в г д ж з к л м н п р с т ф х".split(), "greek": "β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split()}
_VOWELS = {"latin": "a e i o".split(), "cyrillic": "а е и о".split(), "greek": "α ε ι ο".split()}
_ENDS = {
    "latin": {"male": "o n r k".split(), "female": "a ia ina ella".split(), "neutral": "e is en el".split()},
    "cyrillic": {"male": "н р к в".split(), "female": "а ия ина ова".split(), "neutral": "е и ен ель".split()},
    "greek": {"male": "ος ης ας ων".split(), "female": "α ια ινα η".split(), "neutral": "ι ο ου ις".split()},
}


def kind_of(m: Column) -> Column:
    """The type of a mention; what has no pattern's shape is a name without a title."""
    whole = [(name, m.rlike(f"^(?:{p})$")) for name, p in PATTERNS.items() if name != "phone"]
    return reduce(lambda out, x: out.when(x[1], x[0]), whole[1:], F.when(whole[0][1], whole[0][0])).when(m.rlike(r"^[+(0-9]"), "phone").otherwise("name")


def _marked(text: Column, pattern: str | Column, mark: Column) -> Column:
    """Stretches of text between mentions, and mentions, in turn."""
    return F.split(F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.concat(mark, F.lit("$0"), mark)), mark, -1)


def parts_of(m: Column) -> Column:
    """The parts of a name as they are written, without its title."""
    return F.split(F.regexp_replace(m, _TITLE, ""), " ")


def _is_initials(part: Column) -> Column:
    return part.rlike(f"^{_INITIALS}$")


def _odd(pieces: Column) -> Column:
    return F.filter(pieces, lambda _, i: i % 2 == 1)


def pieces_of(text: Column, mark: Column) -> Column:
    """Stretches and mentions of a text in turn, also of names without a title whose parts the text has with one."""
    first = _marked(text, ANY, mark)

    def again(pieces: Column) -> Column:
        titled = F.filter(_odd(pieces), lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
        known = F.filter(F.flatten(F.transform(titled, parts_of)), lambda p: ~_is_initials(p))
        forms = F.array_distinct(F.flatten(F.transform(known, lambda p: F.array(p, F.upper(p), F.initcap(p)))))
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        cut = F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(_marked(p, pattern, mark))))
        return F.when(F.size(titled) == 0, pieces).otherwise(cut)

    return _let(first, again)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def mentions(text: Column) -> Column:
    """The mentions of a text, in order."""
    return _odd(pieces_of(text, F.lit(_MARK)))


def body_of(m: Column, kind: Column) -> Column:
    """What a mention says, without its format: equal for all mentions of one entity. Of a name, all its parts."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(m, r"[^+\d]", ""), rf"^\+(?:{_CALLING}|\d{{3}})", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "email", F.lower(m))
        .when(kind == "name", F.array_join(F.transform(parts_of(m), lambda p: F.when(_is_initials(p), p).otherwise(F.initcap(p))), " "))
        .when(kind == "secret", F.regexp_replace(F.regexp_replace(m, _SECRET_HEAD, ""), '"', ""))
        .otherwise(m)
    )


def gender_of(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLES})\.? ", 1)
    return F.when(F.lower(title).isin([t.lower() for t in MALE]), "male").when(F.lower(title).isin([t.lower() for t in FEMALE]), "female").otherwise("neutral")


def _number(seed: Column, place: Column) -> Column:
    """A number below 16^7 from hexadecimal digits of seed at 7 * place; the digest goes around every 8 places with another start."""
    at = (F.pmod(place, F.lit(8)) * 7 + F.pmod(F.floor(place / 8), F.lit(7)) + 1).cast("int")
    return F.conv(seed.substr(at, F.lit(7)), 16, 10).cast("long")


def _of(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _pick(seed: Column, place: int, words: list[str]) -> Column:
    return _of(words, _number(seed, F.lit(place)))


def _letter(n: Column, base: int, many: int) -> Column:
    return F.chr((F.pmod(n, F.lit(many)) + base).cast("long"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _same_shape(text: Column, seed: Column) -> Column:
    """Digits for digits and letters for letters, of the same case."""

    def one(c: Column, i: Column) -> Column:
        n = _number(seed, i)
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), _letter(n, 97, 26)).when(c.rlike("[A-Z]"), _letter(n, 65, 26)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _more(seed: Column, extra: Column, of) -> Column:
    """extra further signs."""
    return F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: of(_number(seed, 50 - i))), "")).otherwise("")


def _digits(seed: Column, extra: Column) -> Column:
    return _more(seed, extra, lambda n: F.pmod(n, F.lit(10)).cast("string"))


def _octets(text: Column, seed: Column, attempt: Column) -> Column:
    """Octets of the same widths (1 to 9, 10 to 99, 100 to 254); of any from attempt 4 on, and over 255 from attempt 12 on."""

    def one(o: Column, i: Column) -> Column:
        n, size = _number(seed, i), F.length(o)
        part = lambda many, least: F.pmod(n, F.lit(many)) + least
        return F.when(attempt >= 12, part(744, 256)).when(attempt >= 4, part(254, 1)).when(size == 1, part(9, 1)).when(size == 2, part(90, 10)).otherwise(part(155, 100)).cast("string")

    return F.array_join(F.transform(F.split(text, r"\."), one), ".")


def _card(text: Column, seed: Column, extra: Column) -> Column:
    """The first digit, other digits, and the check digit that makes the number valid."""
    drawn = F.concat(text.substr(1, 1), _same_shape(text.substr(F.lit(2), F.length(text) - 2), seed), _digits(seed, extra))

    def checked(d: Column) -> Column:
        digits = F.transform(_chars(F.reverse(d)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
        total = F.aggregate(digits, F.lit(0), lambda a, x: (a + F.when(x > 9, x - 9).otherwise(x)).cast("int"))
        return F.concat(d, F.pmod(10 - total % 10, F.lit(10)).cast("string"))

    return _let(drawn, checked)


def _iban(text: Column, seed: Column, extra: Column) -> Column:
    """The country, valid check digits, and an account of the same shape."""
    account = F.concat(_same_shape(text.substr(F.lit(5), F.length(text) - 4), seed), _digits(seed, extra))

    def checked(d: Column) -> Column:
        rest = F.aggregate(
            _chars(F.concat(d, text.substr(1, 2), F.lit("00"))), F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int")
        )
        return F.concat(text.substr(1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), d)

    return _let(account, checked)


def _phone(text: Column, seed: Column, extra: Column) -> Column:
    """Other digits; of ten digits the number and its exchange begin with 2 to 9."""
    drawn = _same_shape(text, seed)
    lead = lambda n: (F.pmod(_number(seed, F.lit(n)), F.lit(8)) + 2).cast("string")
    return F.concat(F.when(F.length(text) == 10, F.concat(lead(20), drawn.substr(2, 2), lead(21), drawn.substr(5, 6))).otherwise(drawn), _digits(seed, extra))


def _email(text: Column, seed: Column, domain_seed: Column, extra: Column) -> Column:
    """Another user of a domain that stands for the domain: names under example.* stay, being reserved."""
    user, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    other = F.concat(_same_shape(F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), domain_seed), F.lit("."), F.substring_index(domain, ".", -1))
    longer = _more(seed, extra, lambda n: _letter(n, 97, 26))
    return F.concat(_same_shape(user, seed), longer, F.lit("@"), F.when(domain.rlike(r"(?:^|\.)example\.(?:com|net|org)$"), domain).otherwise(other))


def _name(part: Column, gender: Column, seed: Column, extra: Column) -> Column:
    """Syllables of the part's script, with an ending of the gender."""
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def built(s: str) -> Column:
        syllables = [_pick(seed, 2 * k + j, pool) for k in range(3) for j, pool in enumerate((_ONSETS[s], _VOWELS[s]))]
        longer = _more(seed, extra, lambda n: F.concat(_of(_ONSETS[s], n), _of(_VOWELS[s], F.floor(n / 64))))
        ends = {g: _pick(seed, 6, _ENDS[s][g]) for g in ("male", "female", "neutral")}
        return F.initcap(F.concat(*syllables, longer, F.when(gender == "male", ends["male"]).when(gender == "female", ends["female"]).otherwise(ends["neutral"])))

    return F.when(script == "cyrillic", built("cyrillic")).when(script == "greek", built("greek")).otherwise(built("latin"))


def seeds(kind: Column, body: Column, attempt: Column, key: str) -> tuple[Column, Column]:
    """Digests that an entity's surrogate and, for e-mail, its domain's are drawn from."""
    domain = F.sha2(F.concat(F.lit(f"{key}|domain|"), F.substring_index(body, "@", -1)), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), kind, body, attempt.cast("string")), 256), F.when(kind == "email", domain).otherwise(F.lit(""))


def surrogate(kind: Column, body: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The body that stands for (kind, body); of a name, for one part."""
    extra = F.greatest(attempt - 3, F.lit(0))

    def drawn(s: Column) -> Column:
        seed, domain = s.seed, s.domain
        return (
            F.when(kind == "email", _email(body, seed, domain, extra))
            .when(kind == "ip", _octets(body, seed, attempt))
            .when(kind == "card", _card(body, seed, extra))
            .when(kind == "phone", _phone(body, seed, extra))
            .when(kind == "name", F.when(_is_initials(body), _same_shape(body, seed)).otherwise(_name(body, gender, seed, extra)))
            .when(kind == "iban", _iban(body, seed, extra))
            .when(body.rlike("^[0-9a-f]+$") & (kind == "secret"), F.concat(seed, F.reverse(seed), seed).substr(F.lit(1), F.length(body) + extra))
            .otherwise(F.concat(_same_shape(body, seed), _digits(seed, extra)))
        )

    seed, domain = seeds(kind, body, attempt, key)
    return _let(F.struct(seed.alias("seed"), domain.alias("domain")), drawn)


def _like(old: Column, new: Column) -> Column:
    """new with capitals where old has them."""
    raised = F.transform(_chars(new), lambda c, i: F.when(F.substring(old, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.when(old.rlike("[A-Z]"), F.array_join(raised, "")).otherwise(new)


def written(m: Column, kind: Column, body: Column, new: Column) -> Column:
    """The surrogate body in the format of the mention. For names new has a surrogate for each part, between spaces."""
    signs = _chars(m)
    many, own = F.length(F.regexp_replace(m, r"\D", "")), F.length(body)

    def digit(c: Column, i: Column) -> Column:
        # digits of the mention take the digits of the body from the right; what the body lacks (a country code) stays
        before = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), r"\D", ""))
        at = before - (many - own) + 1
        return F.when(c.rlike("[0-9]") & (at >= 1), F.substring(new, at, F.lit(1))).otherwise(c)

    def letter(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), " ", "")) + 1
        return F.when(c != " ", F.substring(new, at, F.lit(1))).otherwise(c)

    past = new.substr(own + 1, F.length(new))  # empty but for surrogates longer than their body
    name = F.zip_with(parts_of(m), F.split(new, " "), lambda p, n: F.when((p == F.upper(p)) & ~_is_initials(p), F.upper(n)).otherwise(n))
    user, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(F.array_join(F.transform(signs, digit), ""), past))
        .when(kind == "iban", F.concat(F.array_join(F.transform(signs, letter), ""), past))
        .when(kind == "name", F.concat(F.regexp_extract(m, _TITLE, 0), F.array_join(name, " ")))
        .when(kind == "secret", F.concat(F.regexp_extract(m, _SECRET_HEAD, 0), new, F.when(m.endswith('"'), F.lit('"')).otherwise(F.lit(""))))
        .when(kind == "email", F.concat(_like(user, F.substring_index(new, "@", 1)), F.lit("@"), _like(domain, F.substring_index(new, "@", -1))))
        .otherwise(new)
    )


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), plain (the stretches between mentions), found (m, kind, body), and entities (kind, body, gender) of each row, once a row and gender."""
    text = F.col("text").cast("string")
    mark = F.when(F.contains(text, F.lit(_MARK)), F.concat(F.lit(_MARK), F.sha2(text, 256), F.lit(_MARK))).otherwise(F.lit(_MARK))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), pieces_of(text, mark).alias("pieces"))
    typed = F.transform(_odd(F.col("pieces")), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    found = F.transform(typed, lambda x: F.struct(x.m.alias("m"), x.kind.alias("kind"), body_of(x.m, x.kind).alias("body")))

    def parts(x: Column) -> Column:
        each = F.split(x.body, " ")
        last, gender = F.size(each) - 1, gender_of(x.m)
        named = F.transform(each, lambda p, i: F.struct(F.lit("name").alias("kind"), p.alias("body"), F.when(i < last, gender).otherwise("neutral").alias("gender")))
        return F.when(x.kind == "name", F.filter(named, lambda p: ~_is_initials(p.body))).otherwise(F.array(F.struct(x.kind.alias("kind"), x.body.alias("body"), F.lit("neutral").alias("gender"))))

    even = F.filter("pieces", lambda _, i: i % 2 == 0)
    both = cut.select("doc_id", "row", even.alias("plain"), found.alias("found"))
    return both.withColumn("entities", F.array_distinct(F.flatten(F.transform("found", parts))))


def entities(seen: DataFrame) -> DataFrame:
    """kind, body, gender of each entity of ``detected`` rows, once, and whether other genders were seen. gender: the least, so that one entity has one."""
    each = seen.select(F.explode("entities").alias("e")).select("e.*")
    return each.groupBy("kind", "body").agg(F.min("gender").alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed"))


def resolved(found: DataFrame, key: str, at_once: int = 8) -> DataFrame:
    """found with attempt and new: surrogates that differ from each other and from all bodies, within their kind."""
    settled, open_, attempt = None, found, 0
    bodies = found.select("kind", F.col("body").alias("new"))
    while True:
        last = attempt + (at_once if attempt else 1)
        tried = open_.withColumn("attempt", F.explode(F.array(*map(F.lit, range(attempt, last)))))
        drawn = tried.withColumn("new", surrogate(F.col("kind"), F.col("body"), F.col("gender"), F.col("attempt"), key))
        taken = bodies if settled is None else bodies.unionByName(settled.select("kind", "new"))
        first = drawn.join(taken, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min(F.struct("attempt", "body", *(c for c in found.columns if c not in ("kind", "body")))).alias("w")).select("kind", "new", "w.*")
        best = first.groupBy("kind", "body").agg(F.min(F.struct("attempt", "new", *(c for c in found.columns if c not in ("kind", "body")))).alias("w"))
        good = materialize(best.select("kind", "body", "w.*"), "surrogates")
        settled, attempt = good if settled is None else settled.unionByName(good), last
        open_ = found.join(settled.select("kind", "body"), ["kind", "body"], "left_anti")
        if open_.isEmpty():
            return settled


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.length(F.to_json(column)) + 64)).first()[0] or 0


def _exceptions(seen: DataFrame, key: str, most_broadcast: int) -> DataFrame:
    """row and over (a map from kind and body to a surrogate) of the rows that mention entities whose surrogate isn't what their own text draws at attempt 0."""
    tried = resolved(entities(seen), key)
    special = tried.where("attempt > 0 or mixed").select("kind", "body", "attempt", F.col("gender").alias("right"), "new")
    special = materialize(special, "special")
    size = special.agg(F.sum(F.length("body") + F.length("new") + 64)).first()[0] or 0
    each = seen.select("row", F.explode("entities").alias("e")).groupBy("row", "e.kind", "e.body").agg(F.min("e.gender").alias("gender"))
    hit = each.join(F.broadcast(special) if size <= most_broadcast else special, ["kind", "body"]).where("attempt > 0 or gender <> right")
    return materialize(hit.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "body"), "new"))).alias("over")), "overrides")


def replace_pii(docs: DataFrame, key: str = "surrogates-1", most_broadcast: int = 32 << 20) -> DataFrame:
    """doc_id, n_entities (mentions replaced), n_distinct, kinds, and text with every mention replaced."""
    seen = materialize(detected(docs), "mentions")
    over = _exceptions(seen, key, most_broadcast)
    rows = seen.join(F.broadcast(over) if _bytes(over, "over") <= most_broadcast else over, "row", "left")

    def stands(kind: Column, body: Column) -> Column:
        own = F.array_min(F.transform(F.filter("entities", lambda e: (e.kind == kind) & (e.body == body)), lambda e: e.gender))
        drawn = surrogate(kind, body, F.when(kind == "name", F.coalesce(own, F.lit("neutral"))).otherwise("neutral"), F.lit(0), key)
        return F.coalesce(F.col("over")[F.concat_ws("|", kind, body)], drawn)

    def swapped(x: Column) -> Column:
        new = F.when(x.kind == "name", F.array_join(F.transform(F.split(x.body, " "), lambda p: stands(F.lit("name"), p)), " ")).otherwise(stands(x.kind, x.body))
        return _let(new, lambda n: written(x.m, x.kind, x.body, n))

    made = F.transform("found", swapped)
    pieces = F.zip_with("plain", made, lambda a, x: F.concat(a, F.coalesce(x, F.lit(""))))
    some = F.coalesce(F.size("found"), F.lit(0)) > 0
    return rows.select(
        "doc_id",
        F.when(some, F.size("found")).otherwise(0).cast("long").alias("n_entities"),
        F.when(some, F.size(F.array_distinct("found.m"))).otherwise(0).cast("long").alias("n_distinct"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct("found.kind")), ",")).otherwise("").alias("kinds"),
        F.when(some, F.array_join(pieces, "")).otherwise(F.col("plain")[0]).alias("text"),
    )
