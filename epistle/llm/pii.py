"""Surrogates for personal data: keyed, type-consistent, collision-checked, in SQL functions only.

One regular expression finds all entities of a text; every repetition in it is bounded or possessive over one
class, so that no text can exhaust the stack. In documents that name somebody behind a title, capitalised words
are looked at as well: those that are parts of such a name, and given names before its surname, are mentions.

An entity falls into pieces (a name into its words, an address into mailbox and domain, anything else is one piece); a
piece's canonical form decides its surrogate, so that spellings of one entity agree wherever they occur.
Surrogates come from SHA-512 of key, type, canonical form and attempt; those that equal another's or occur as an
original are given the next attempt, which from some point on makes longer ones, until all differ. Check digits of cards
and account numbers hold where the original's do. The surrogate is then poured into the form found
in the text: its separators, its case, its script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_prefix, stage

# Forms of personal data.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,126}[A-Za-z]{2,63}"
_IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,45}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
_IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?![\w\-])"
_CARD = r"(?<![\w.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\w\-])"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_SECRET = r"(?<!\w)(?:[0-9a-f]{32,256}|[0-9A-F]{32,256}|AKIA[0-9A-Z]{16}|gh[pousr]_\w{36}|sk-[A-Za-z0-9\-_]{20,256})(?!\w)"
_FEMALE = "Mrs|Ms|Miss|Mme|Madame|Frau|Sra|Signora|г-жа|κυρία"
_MALE = "Mr|Herr|Sr|Monsieur|Signor|г-н|κύριος"
_NEUTRAL = "Dr|Prof"
_WORD = r"\p{Lu}(?:\p{L}++(?:['’\-]\p{L}++){0,4}+|['’]\p{L}++(?:['’\-]\p{L}++){0,3}+)"
_NAME = rf"(?<![\w.])(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.? (?:(?:\p{{Lu}}\.|{_WORD}) ){{0,3}}{_WORD}"
_RUN = rf"(?<![\p{{L}}\p{{N}}'’\-]){_WORD}(?: {_WORD}){{0,3}}(?![\p{{L}}\p{{N}}])"
TYPES = {"email": _EMAIL, "ipv6": _IPV6, "ipv4": _IPV4, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "iban": _IBAN, "secret": _SECRET, "name": _NAME}
ENTITY = "|".join(TYPES.values())
#: What is looked at in documents that name somebody.
WIDE = f"{ENTITY}|{_RUN}"
# Capitalised words before a surname that are no given names.
_STARTERS = (
    "a an and as at both but by dear did for from had has her his if in is my no of on one or our since so that the their then this to was we when while with yes your "
    "aber als am auf das der die ein eine er es für im mit sie und von wir zu il elle et la le les un une dans pour que el ella en los por una y"
).split()

# Syllables of generated names by script; the endings tell the gender of a given name.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ha he jo ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi",
    "cyrillic": "ба бе ва ве ви га да де ди жа за зи ка ки ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се со та те ти то фа хо ша",
    "greek": "βα γα γε δα δε δι ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε τι το φα φι χα",
}
_ROLES = ("any", "female", "male", "surname")
_ENDINGS = {"latin": ("l", "na", "n", "s"), "cyrillic": ("л", "на", "н", "в"), "greek": ("λ", "να", "ς", "ς")}
#: Attempts in the original's length; each further one is longer by a character, so that there is always room.
SAME_LENGTH = 3


def _byte(digest: Column, i: Column) -> Column:
    """Byte i (from 0, around the end) of a digest in hexadecimal."""
    return F.conv(F.substring(digest, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(digest: Column, i, words: str) -> Column:
    options = words.split()
    return F.element_at(F.array(*map(F.lit, options)), _byte(digest, i) % len(options) + 1)


def _stem(digest: Column, last: Column, syllables: str) -> Column:
    """Syllables 0 to `last`."""
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: _pick(digest, i, syllables)), "")


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once, not wherever f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _each(text: Column, f) -> Column:
    """f(character, place from 0) of each character; none for an empty text."""

    def of(t):
        place = F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.length(t) - 1))
        return F.transform(place, lambda i: f(F.substring(t, i + 1, F.lit(1)), i))

    return _let(text, of)


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def luhn(digits: Column) -> Column:
    """The sum of Luhn's test over digits; a multiple of ten passes."""

    def of(d):
        each = _each(d, lambda c, i: F.when((F.length(d) - i) % 2 == 0, (2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    return _let(digits, of)


def mod97(account: Column) -> Column:
    """The remainder of an account number (lower case): 1 if its check digits hold."""
    turned = _let(account, lambda a: F.concat(F.substring(a, F.lit(5), F.length(a)), F.substring(a, F.lit(1), F.lit(4))))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 87) % 97
    return F.aggregate(_each(turned, lambda c, i: c), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


def _type_of(surface: Column) -> Column:
    """The type of a surface; null for what only looks like one: digits that are no card, words that are no name.
    Cards have 16 digits or pass Luhn's test."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        hit = surface.rlike(f"^(?:{pattern})$")
        if name == "card":
            digits = F.regexp_replace(surface, "[^0-9]", "")
            hit &= (F.length(digits) == 16) | (luhn(digits) % 10 == 0)
        found = F.when(hit, name).otherwise(found)
    return found


def _kept(kind: Column, surface: Column) -> tuple[Column, Column]:
    """What stays of a surface before and behind its body: country codes, top-level domains, titles."""
    before = F.when(kind == "phone", F.regexp_extract(surface, r"^\+\d{1,3}(?=[ .(\-])", 0)).when(
        kind == "name", F.regexp_extract(surface, r"^\S+ ", 0)).when(kind == "secret", F.regexp_extract(surface, r"^(?:AKIA|gh[pousr]_|sk-)", 0)).otherwise("")
    return before, F.when(kind == "email", F.regexp_extract(surface, r"\.[A-Za-z]+$", 0)).otherwise("")


def _name_kind(word: Column, role: Column) -> Column:
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return F.concat_ws(":", F.lit("name"), script, role)


_PIECE = "struct<kind:string,canon:string,shape:string>"


def _piece(kind: Column, canon: Column, shape: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), shape.alias("shape"))


def surfaces_with_pieces(surfaces: DataFrame) -> DataFrame:
    """Typed surfaces (distinct strings) -> surface, type, before, behind, sep and pieces: array of struct(kind, canon,
    shape). An initial is a piece without kind."""
    kind = F.col("type")
    before, behind = _kept(kind, F.col("surface"))
    named = surfaces.withColumn("type", _type_of(F.col("surface"))).where("type IS NOT NULL").withColumns({"before": before, "behind": behind})
    body = F.expr("substring(surface, length(before) + 1, length(surface) - length(before) - length(behind))")
    named = named.withColumn("body", body)
    words = F.split("body", " ")
    given = F.when(F.col("before").rlike(f"^(?:{_FEMALE})"), "female").when(F.col("before").rlike(f"^(?:{_MALE})"), "male").otherwise("any")
    role = lambda i: F.when(i == F.size(words) - 1, "surname").otherwise(given)
    of_name = F.transform(words, lambda w, i: _piece(F.when(~w.endswith("."), _name_kind(w, role(i))), F.lower(w), w))
    halves, whole = F.split("body", "@"), F.lower(F.concat(F.col("body"), F.col("behind")))
    domain = F.substring_index(whole, "@", -1)
    of_mail = F.array(_piece(F.concat(F.lit("mailbox:"), domain), whole, F.get(halves, F.lit(0))), _piece(F.lit("domain"), domain, F.get(halves, F.lit(1))))
    canon = F.when(kind.isin("ipv4", "ipv6"), F.lower("body")).otherwise(_plain(F.col("body")))
    pieces = F.when(kind == "name", of_name).when(kind == "email", of_mail).otherwise(F.array(_piece(kind, canon, F.col("body"))))
    sep = F.when(kind == "name", " ").when(kind == "email", "@").otherwise("")
    return named.withColumns({"pieces": pieces.cast(f"array<{_PIECE}>"), "sep": sep}).drop("body")


def _form(kind: Column, canon: Column) -> Column:
    """The letters and digits that a surrogate replaces one by one."""
    mailbox = F.substring_index(canon, "@", 1)
    return _plain(F.when(kind.startswith("mailbox:"), mailbox).when(kind == "domain", F.regexp_replace(canon, r"\.[a-z]+$", "")).otherwise(canon))


def _with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt and surrogate, in canonical form. Worked out column by column, as later ones use earlier ones often."""
    kind, canon, attempt, digest, form, shaped = map(F.col, ("kind", "canon", "attempt", "digest", "form", "shaped"))

    def like(c, i):
        # every 64 characters the digest is mixed with the place, so that long forms don't repeat
        b = (_byte(digest, i) + 7 * F.floor(i / 64)).cast("int")
        hexadecimal = (kind == "ipv6") | (kind == "secret") & canon.rlike("^[0-9a-f]+$")
        letter = F.when(hexadecimal, F.substring(F.lit("abcdef"), b % 6 + 1, F.lit(1))).otherwise(F.char(97 + b % 26))
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).otherwise(letter)

    filler = F.when(form.rlike("^[0-9]+$"), "0").otherwise("a")
    longer = F.concat(form, F.when(attempt > SAME_LENGTH, F.repeat(filler, attempt - SAME_LENGTH)).otherwise(""))
    # check digits: the last of a card, the two behind the country of an account
    front = F.substring(shaped, F.lit(1), F.length(shaped) - 1)
    card = F.when(luhn(canon) % 10 == 0, F.concat(front, ((10 - luhn(F.concat(front, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(shaped)
    behind, country = F.substring(shaped, F.lit(5), F.length(shaped)), F.substring(canon, F.lit(1), F.lit(2))
    check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), behind))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(mod97(canon) == 1, check).otherwise(F.substring(shaped, F.lit(3), F.lit(2))), behind)
    first = F.when(attempt > SAME_LENGTH, _byte(digest, F.lit(0))).otherwise(_byte(digest, F.lit(0)) % 16 + 240)
    more = F.when(attempt > 2 * SAME_LENGTH, F.concat(F.lit("."), attempt.cast("string"))).otherwise("")
    address = F.concat(F.concat_ws(".", first, *[_byte(digest, F.lit(i)) for i in (1, 2, 3)]), more)
    made = F.when(kind == "ipv4", address).when(kind == "card", card).when(kind == "iban", iban)
    for script, syllables in _SYLLABLES.items():
        for role, ending in zip(_ROLES, _ENDINGS[script]):
            count = F.floor(attempt / 2).cast("int") + (2 if role == "surname" else 1)
            stem = _stem(digest, count, syllables)
            made = made.when(kind == f"name:{script}:{role}", F.concat(stem, F.lit(ending)))
    keyed = entities.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", "attempt").cast("binary"), 512)).withColumn("form", _form(kind, canon))
    return keyed.withColumn("shaped", F.array_join(_each(longer, like), "")).withColumn("surrogate", made.otherwise(shaped)).drop("digest", "form", "shaped")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon -> surrogate, all different within a kind and none an original of it.

    Of those that share a surrogate the least canonical form keeps it; the others, and any whose
    surrogate is an original, try again. Each round leaves far fewer, and beyond SAME_LENGTH attempts surrogates grow, so
    the rounds end however crowded a kind is. Each round writes only what it has settled."""
    todo = entities.select("kind", "canon").withColumn("attempt", F.lit(0))
    original = F.when(F.col("kind").isin("ipv4", "iban") | F.col("kind").startswith("name:"), F.col("canon")).otherwise(_form(F.col("kind"), F.col("canon")))
    used, settled = todo.select("kind", original.alias("surrogate")).distinct(), []
    while True:
        taken = reduce(DataFrame.unionByName, [used, *(x.select("kind", "surrogate") for x in settled)])
        tried = _with_surrogate(todo, key).join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        least = F.min(F.when(F.col("taken").isNull(), F.col("canon"))).over(Window.partitionBy("kind", "surrogate"))
        judged = stage(tried.withColumn("wins", F.col("taken").isNull() & (F.col("canon") == least)).drop("taken"), "pii-surrogates")
        settled.append(judged.where("wins").select("kind", "canon", "surrogate"))
        todo = judged.where("NOT wins").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def _cased(shape: Column, made: Column) -> Column:
    """A name in the case of a word."""
    return F.when((F.length(shape) > 1) & (shape == F.upper(shape)), F.upper(made)).otherwise(F.initcap(made))


def _poured(kind: Column, shape: Column, made: Column) -> Column:
    """Surrogate characters in place of the shape's letters and digits, in their case; further ones behind."""

    def char(c, i):
        n = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        new = F.substring(made, n, F.lit(1))
        return F.when(~c.rlike("[A-Za-z0-9]"), c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)

    rest = F.substring(made, F.length(_plain(shape)) + 1, F.length(made))
    return F.when(kind == "ipv4", made).when(kind.startswith("name:"), _cased(shape, made)).otherwise(F.concat(F.array_join(_each(shape, char), ""), rest))


def _surface_map(split: DataFrame, chosen: DataFrame) -> DataFrame:
    """surface -> replacement."""
    parts = split.select("surface", F.posexplode("pieces").alias("at", "piece")).select("surface", "at", "piece.kind", "piece.canon")
    made = parts.join(chosen, ["kind", "canon"]).groupBy("surface").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("made"))
    last = F.get(F.map_values("made"), F.lit(0))
    poured = F.transform("pieces", lambda p, i: F.when(p.kind.isNull(), F.concat(F.upper(F.substring(last, 1, 1)), F.lit("."))).otherwise(
        _poured(p.kind, p.shape, F.element_at("made", i))))
    replacement = F.concat("before", F.call_function("array_join", poured, F.col("sep")), "behind")
    return split.join(made, "surface").select("surface", replacement.alias("replacement"))


def _mentions(spots: DataFrame, split: DataFrame) -> DataFrame:
    """id, hash, at, i, word, kind, canon: the words of capitalised runs in documents with names. kind is that of the same part of a
    name of the document (given names before surnames where both fit), or a given name's before a surname, or null."""
    names = spots.join(split.where("type = 'name'").select("surface", "pieces"), "surface").select("id", "hash", F.explode("pieces").alias("p")).where("p.kind IS NOT NULL")
    known = names.groupBy("id", "hash", F.col("p.canon").alias("canon")).agg(F.min("p.kind").alias("kind"))
    runs = spots.join(split.select("surface"), "surface", "left_anti").where(F.col("surface").rlike(f"^{_RUN}$"))
    words = runs.select("id", "hash", "at", F.posexplode(F.split("surface", " ")).alias("i", "word")).withColumn("canon", F.lower("word"))
    same = known.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), F.col("canon").alias("canon_"), "kind")
    met = words.join(same, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")) & (F.col("canon") == F.col("canon_")), "left")
    listed = met.groupBy("id", "hash", "at").agg(F.array_sort(F.collect_set(F.struct("i", "word", "canon", "kind"))).alias("words"))
    listed = listed.where(F.exists("words", lambda w: w.kind.isNotNull()))
    after = lambda i: F.get(F.col("words"), i + 1).kind
    given = lambda w, i: F.when(w.kind.isNull() & after(i).endswith("surname") & ~w.canon.isin(*_STARTERS), _name_kind(w.word, F.lit("any")))
    known_or_given = F.transform("words", lambda w, i: F.struct(w.i.alias("i"), w.word.alias("word"), w.canon.alias("canon"), F.coalesce(w.kind, given(w, i)).alias("kind")))
    return listed.select("id", "hash", "at", F.explode(known_or_given).alias("w")).select("id", "hash", "at", "w.*")


def replace_entities(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """docs with every entity of `text` replaced, and n_entities (long). key: the secret that surrogates come from.

    Documents without entities come back unchanged, null and empty texts too (n_entities 0). Rows are told apart by
    doc_id (null counts as a value) and text, so repeated rows are replaced alike. An empty
    table gives no rows. Other columns are kept whatever their names; a column n_entities is replaced. Not found: secrets of more than 256 characters, names of
    people whom the document nowhere names behind a title, postal addresses, dates of birth.
    """
    if not key:
        raise ValueError("a key is needed")
    named = lambda found: F.exists(found, lambda s: s.rlike(f"^(?:{_NAME})$"))
    # texts are searched again, for names' parts too, only where a name was found
    searched = F.transform(F.array(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), lambda f: F.when(
        named(f), F.struct(F.lit(True).alias("wide"), F.regexp_extract_all(text, F.lit(WIDE), F.lit(0)).alias("found"))).otherwise(F.struct(F.lit(False).alias("wide"), f.alias("found"))))
    found = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), F.get(searched, F.lit(0)).alias("s")).select("id", "hash", "s.*").where("size(found) > 0")
    found = stage(found, "pii-found")
    spots = found.select("id", "hash", "wide", F.posexplode("found").alias("at", "surface"))
    split = stage(surfaces_with_pieces(spots.select("surface").distinct()), "pii-surfaces")
    mentions = stage(_mentions(spots.where("wide"), split), "pii-mentions")
    parts = split.select(F.explode("pieces").alias("p")).select("p.kind", "p.canon").unionByName(mentions.select("kind", "canon"))
    chosen = assign(parts.where("kind IS NOT NULL").distinct(), key)
    mapped = stage(_surface_map(split, chosen), "pii-map")
    word = F.coalesce(_cased(F.col("word"), F.col("surrogate")), F.col("word"))
    of_runs = mentions.join(chosen, ["kind", "canon"], "left").groupBy("id", "hash", "at").agg(F.array_sort(F.collect_set(F.struct(F.col("i"), word.alias("new")))).alias("words"))
    of_runs = of_runs.select("id", "hash", F.lit(True).alias("wide"), "at", F.array_join(F.col("words.new"), " ").alias("replacement"))
    of_surfaces = spots.join(mapped, "surface").select("id", "hash", "wide", "at", "replacement")
    made = of_surfaces.unionByName(of_runs).groupBy("id", "hash", "wide").agg(F.map_from_entries(F.collect_set(F.struct("at", "replacement"))).alias("new"))
    own = own_prefix(docs)
    made = made.select(F.struct("id", "hash").alias(own), F.struct("wide", "new").alias(own + "made"))
    keyed = docs.drop("n_entities").withColumn(own + "key", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash")))
    same = F.col(f"{own}key.id").eqNullSafe(F.col(f"{own}.id")) & (F.col(f"{own}key.hash") == F.col(f"{own}.hash"))
    joined = keyed.join(made, same, "left")
    new, at = F.col(f"{own}made.new"), F.col(f"{own}made.wide")
    pattern = F.when(at, F.lit(WIDE)).otherwise(F.lit(ENTITY))
    old = F.concat(F.regexp_extract_all(text, pattern, F.lit(0)), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(F.split(F.col(text), pattern, -1), F.transform(old, lambda s, i: F.coalesce(F.element_at(new, i), s)), lambda a, b: F.concat(a, b)), "")
    out = joined.withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(rebuilt)).withColumn("n_entities", F.coalesce(F.size(new), F.lit(0)).cast("long"))
    return out.select(*[c for c in docs.columns if c != "n_entities"], "n_entities")
