"""PII replaced by surrogates, with DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, US social security numbers, phone numbers, card
numbers that pass the Luhn test, names of one or two words after a title, and where such a name
stands in the same text without a title, whole or by one of its words. A surrogate is derived
from a secret key, the type and the canonical form of what was found, so the same person or
number has the same surrogate everywhere, whatever separators or case it is written with. It
keeps type and format: digits become digits and letters letters of the same case, separators
stay, a country code and a card's first digit stay, a card passes the Luhn test again, an
address has four octets, mail of one domain stays mail of one domain; a name keeps titles,
number of words, script (Latin or Cyrillic) and an ending of its gender.

The titles are no part of a name's canonical form, the gender that they tell is; some tell
none and agree with any. A part of a name belongs to the last full name before it in the text
that it agrees with in gender and word, else to the first after it, and gets that part of the
full name's surrogate: a surname rather than a first name. A number with ``+`` and one without
are different entities, as only the former has a country code.

Distinctness is checked on the table of distinct entities, which is small beside the texts: a
surrogate that two entities share, or that is itself an entity found in the corpus, is derived
anew from a further attempt until none is left. Later attempts are longer, so that a format
with few forms doesn't run out of them. The few entities with later attempts reach the texts
as a constant map, or by a join where there are more than ``CONSTANTS`` of them. Texts are
matched once, in a table in the shared folder, and split again only where something was found.

The key comes from the session's ``spark.weirflow.surrogateKey`` or the environment's
``WEIRFLOW_SURROGATE_KEY``; without either, each run draws its own, and surrogates of different
runs have nothing in common.

Defined results for odd input: a null text stays null and an empty one empty, with no
entities; null ids are carried along; equal rows each get their own, equal result; an empty
table gives an empty result. Very long texts are read whole. All columns of the input are kept
under any names; the columns added are ``n_entities`` and, if asked for, ``entities``, which
replace columns so named.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fingerprints import bounded
from .staging import discard, stage, table

#: Entities with a later attempt that are put into the plan as a constant.
CONSTANTS = 200
#: Rounds of checks, and attempts from which on mail and names, and numbers, get longer.
ATTEMPTS, LONGER, DIGITS = 200, 4, 16
KEY = "spark.weirflow.surrogateKey"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "госпожа")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "доктор", "профессор")
_WORD = r"(?:\p{Lu}\p{Ll}+)+"
_NAME = rf"(?:\p{{Lu}}['’])?{_WORD}(?:[-'’]{_WORD})*+"
_TITLE = rf"(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?"
_TITLES = rf"(?:{_TITLE} )++"
#: Pattern of each type; none has a capturing group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ipv4": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w])(?!\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{8,15}(?!\w)|(?<![\w+])\+[0-9]{1,3}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,4}){2,3}(?!\w)|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w-])",
    "card": r"(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\w])",
    "name": rf"(?<![\w])(?:{_TITLE} )+(?:{_NAME}|\p{{Lu}}\.(?= \p{{Lu}}))(?: {_NAME})?(?!\w)",
}
_NUMBERS = "|".join(PATTERNS[k] for k in ("ipv4", "ssn", "phone", "card"))
#: All of them; a look at the next character saves most of the work.
PATTERN = f"(?=[0-9+(])(?:{_NUMBERS})|(?=[{''.join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))}]){PATTERNS['name']}|(?=[A-Za-z0-9._%+-]){PATTERNS['email']}"
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SYLLABLES = ("ba", "de", "fi", "ga", "ho", "ju", "ka", "le", "mi", "no", "pa", "re", "sa", "te", "vi", "zo")
_GREEK = ("βα", "δε", "φι", "γα", "χο", "λου", "κα", "λε", "μι", "νο", "πα", "ρε", "σα", "τε", "βι", "ζο")
_CYRILLIC = ("ба", "де", "фи", "га", "хо", "ю", "ка", "ле", "ми", "но", "па", "ре", "са", "те", "ви", "зо")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last is the check digit."""
    chars = F.reverse(F.split(digits, ""))
    worth = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b)


def kind_of(match: Column) -> Column:
    """The type of a match of PATTERN; null if it is no entity after all (a number that isn't a card's)."""
    first = F.when(match.contains("@"), "email").when(match.rlike(f"^(?:{PATTERNS['ipv4']})$"), "ipv4").when(match.rlike(f"^(?:{PATTERNS['ssn']})$"), "ssn")
    first = first.when(match.rlike(r"^[^0-9(+]"), "name").when(match.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -][0-9]{4}){3}$"), F.when(_luhn_sum(_digits(match)) % 10 == 0, "card"))
    return first.otherwise("phone")


def _titles(name: Column) -> Column:
    return F.regexp_extract(name, f"^{_TITLES}", 0)


def _words(name: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(name, f"^{_TITLES}", "")


def _gender(name: Column) -> Column:
    """m or f, n if the titles tell none, ? without a title."""
    has = lambda titles: _titles(name).rlike(rf"(^| )({'|'.join(titles)})\.? ")
    return F.when(has(MALE), "m").when(has(FEMALE), "f").when(has(NEUTRAL), "n").otherwise("?")


def canonical(kind: Column, match: Column) -> Column:
    """What makes two matches the same entity."""
    number = F.concat(F.when(match.startswith("+"), "+").otherwise(""), _digits(match))
    name = F.concat(_gender(match), F.lit(" "), F.lower(_words(match)))
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "name", name).otherwise(F.lower(match))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _linked(found: Column) -> Column:
    """The matches, parts of names with the canonical form of the full name that they belong to."""
    gender = lambda e: F.substring(e["canon"], 1, 1)
    tail = lambda e: F.substring(e["canon"], 3, 1000)
    last, first = (lambda e: F.substring_index(tail(e), " ", -1)), (lambda e: F.substring_index(tail(e), " ", 1))
    is_name, whole = (lambda e: e["kind"] == "name"), (lambda e: tail(e).contains(" "))
    full = lambda e: is_name(e) & whole(e) & (gender(e) != "?")
    agree = lambda a, b: (gender(a) == gender(b)) | gender(a).isin("n", "?") | gender(b).isin("n", "?")
    told = lambda e: gender(e).isin("m", "f")

    def nearest(every: Column, i: Column, fits: Callable[[Column], Column]) -> Column:
        """The canonical form of the last fitting match before, else of the first after."""
        return F.coalesce(F.try_element_at(F.filter(F.slice(every, F.lit(1), i), fits), F.lit(-1))["canon"], F.get(F.filter(every, fits), F.lit(0))["canon"])

    def with_gender(every: Column, e: Column, i: Column) -> Column:
        """Full names without a gender that stand with one elsewhere."""
        return F.when(full(e) & ~told(e), nearest(every, i, lambda x: full(x) & told(x) & (tail(x) == tail(e))))

    def of_parts(every: Column, e: Column, i: Column) -> Column:
        same = lambda x: full(x) & (tail(x) == tail(e))
        surname = lambda x: full(x) & (last(x) == tail(e)) & agree(x, e)
        given = lambda x: full(x) & (first(x) == tail(e))
        single = lambda x: is_name(x) & (gender(x) != "?") & (tail(x) == tail(e))
        bare = gender(e) == "?"
        part = F.coalesce(nearest(every, i, surname), F.when(bare, F.coalesce(nearest(every, i, given), nearest(every, i, single))))
        return F.when(is_name(e) & ~full(e), F.when(whole(e), nearest(every, i, same)).otherwise(part))

    def linked(every: Column, link: Callable[[Column, Column, Column], Column]) -> Column:
        return F.transform(every, lambda e, i: F.struct(e["kind"].alias("kind"), e["match"].alias("match"), F.coalesce(link(every, e, i), e["canon"]).alias("canon")))

    done = _once(_once(found, lambda every: linked(every, with_gender)), lambda every: linked(every, of_parts))
    return F.when(F.exists(found, is_name), done).otherwise(found)


def _matches(text: Column, pattern: Column) -> Column:
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kinds = F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match")))
    return F.transform(kinds, lambda e: F.struct(e["kind"].alias("kind"), e["match"].alias("match"), canonical(e["kind"], e["match"]).alias("canon")))


def _with_names(found: Column) -> Column:
    """PATTERN and the names found after titles, whole and by their words; null if there are none."""
    names = F.transform(F.filter(found, lambda e: e["kind"] == "name"), lambda e: _words(e["match"]))
    whole, words = F.filter(names, lambda n: n.contains(" ")), F.filter(F.flatten(F.transform(names, lambda n: F.split(n, " "))), lambda w: ~w.endswith("."))
    known = F.regexp_replace(F.array_join(F.array_distinct(F.concat(whole, words)), "|"), r"\.", r"\\.")
    edge = r"[\p{L}\p{N}_]"
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{PATTERN}|(?<!{edge})(?:"), known, F.lit(f")(?!{edge})")))


def with_entities(docs: DataFrame, text_col: str, found: str, pattern: str) -> DataFrame:
    """``docs`` with all matches, entities or not, in order, as array<struct<kind, match, canon>>, and the pattern that finds them."""
    text = F.col(text_col)
    rows = docs.withColumn(found, _matches(text, F.lit(PATTERN))).withColumn(pattern, _with_names(F.col(found)))
    again = F.when(F.col(pattern).isNull(), F.col(found)).otherwise(_matches(text, F.col(pattern)))
    rows = rows.withColumn(found, _linked(again))
    return rows.withColumn(pattern, F.coalesce(F.col(pattern), F.lit(PATTERN)))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 pseudo-random hex digits of an entity."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _hex(stream: Column, place: Column, size: int = 2) -> Column:
    """The number at a place of the stream; places go around."""
    return F.conv(F.substring(stream, F.pmod(place * size, F.lit(126)).cast("int") + 1, F.lit(size)), 16, 10).cast("int")


def _reshape(match: Column, stream: Column, kept: Column) -> Column:
    """Letters and digits from the stream in place of the match's own, beyond the first ``kept`` digits or letters.

    Of digits, the first that is replaced is at least 2.
    """

    def step(acc: Column, c: Column) -> Column:
        n, drawn = acc["n"], _hex(stream, acc["n"])
        is_digit, is_lower, is_upper = c.rlike("^[0-9]$"), c.rlike("^[a-z]$"), c.rlike("^[A-Z]$")
        plain = is_digit | is_lower | is_upper
        new = F.when(is_digit, F.when(n == kept, (drawn % 8 + 2).cast("string")).otherwise((drawn % 10).cast("string"))).when(is_lower, F.char(drawn % 26 + 97)).otherwise(F.char(drawn % 26 + 65))
        return F.struct(F.concat(acc["out"], F.when(plain & (n >= kept), new).otherwise(c)).alias("out"), (n + F.when(plain, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]


def _name(match: Column, stream: Column, canon: Column, attempt: Column) -> Column:
    gender, words, whole = F.substring(canon, 1, 1), F.split(_words(match), " "), F.split(F.substring(canon, 3, 1000), " ")
    syllables = F.least(F.lit(10), 5 + F.floor(attempt / LONGER)).cast("int")
    # the place in the full name of the words written
    ahead = F.greatest(F.array_position(whole, F.lower(words[0])).cast("int") - 1, F.lit(0))
    # a last word that is also the first one stands last, if alone
    ahead = F.when(F.size(words) == 1, F.when(F.element_at(whole, -1) == F.lower(words[0]), F.size(whole) - 1).otherwise(ahead)).otherwise(F.lit(0))

    def word(w: Column, i: Column) -> Column:
        cyrillic, greek = w.rlike(r"^\p{IsCyrillic}"), w.rlike(r"^\p{IsGreek}")
        said = F.split(F.when(cyrillic, " ".join(_CYRILLIC)).when(greek, " ".join(_GREEK)).otherwise(" ".join(_SYLLABLES)), " ")
        ends = F.split(F.when(cyrillic, "н на р").when(greek, "ς να ρ").otherwise("n la r"), " ")
        end = F.element_at(ends, F.when(gender == "m", 1).when(gender == "f", 2).otherwise(3))
        chosen = F.transform(F.sequence(F.lit(0), syllables - 1), lambda k: F.element_at(said, _hex(stream, (i + ahead) * 10 + k, 1) + 1))
        made = F.initcap(F.concat(F.array_join(chosen, ""), end))
        return F.when(w.endswith("."), F.concat(F.substring(made, 1, 1), F.lit("."))).otherwise(made)

    return F.concat(_titles(match), F.array_join(F.transform(words, word), " "))


def surrogate(key: str, kind: Column, match: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a match, in its format; a match that is no entity stays."""

    def card(stream: Column) -> Column:
        def checked(new: Column) -> Column:
            zero = F.concat(F.regexp_replace(_digits(new), "[0-9]$", ""), F.lit("0"))
            return F.concat(F.regexp_replace(new, "[0-9]$", ""), ((10 - _luhn_sum(zero) % 10) % 10).cast("string"))

        return _once(_reshape(match, stream, F.lit(1)), checked)

    def number(stream: Column) -> Column:
        more = F.array_join(F.transform(F.sequence(F.lit(0), attempt - DIGITS), lambda i: (_hex(stream, i + 30) % 10).cast("string")), "")
        return F.concat(_reshape(match, stream, F.length(F.regexp_extract(canon, _COUNTRY, 1))), F.when(attempt >= DIGITS, more).otherwise(""))

    def mail(stream: Column) -> Column:
        domain = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.lower(F.substring_index(match, "@", -1))), 256), 1, 16)
        longer = F.substring(stream, F.lit(101), F.least(F.lit(20), F.greatest(F.lit(0), 2 * (attempt - LONGER))))
        return F.concat(_reshape(F.substring_index(match, "@", 1), stream, F.lit(0)), longer, F.lit("@m"), domain, F.lit(".example.org"))

    def made(stream: Column) -> Column:
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_hex(stream, i) % 254 + 1).cast("string")), ".")
        return F.when(kind == "email", mail(stream)).when(kind == "ipv4", octets).when(kind == "card", card(stream)).when(kind == "name", _name(match, stream, canon, attempt)).when(kind.isin("phone", "ssn"), number(stream)).otherwise(match)

    return _once(_stream(key, kind, canon, attempt), made)


def found_entities(rows: DataFrame, found: str) -> DataFrame:
    """The distinct entities of all texts: kind, canon, and the least of the forms in which it is written whole.

    All whole forms of an entity have surrogates of one canonical form, so one form stands for them.
    """
    each = rows.select(F.explode(found).alias("e")).select("e.kind", "e.canon", "e.match").where("kind IS NOT NULL")
    least = F.min(F.struct((-F.size(F.split(_words(F.col("match")), " "))).alias("n"), (_titles(F.col("match")) == "").alias("bare"), "match"))
    return each.groupBy("kind", "canon").agg(least["match"].alias("match"))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """``found`` with the first attempt whose surrogate is no other entity's and no entity itself."""
    held = stage(found, "entities")
    named = held.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        # a name's gender may be told by another title than the form's own
        its = lambda new: F.when(F.col("kind") == "name", F.concat(F.substring("canon", 1, 1), F.lit(" "), F.lower(_words(new)))).otherwise(canonical(F.col("kind"), new))
        made = named.withColumn("made", _once(surrogate(key, F.col("kind"), F.col("match"), F.col("canon"), F.col("attempt")), its))
        made = made.withColumn("place", F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "canon")))
        real = named.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        checked = made.join(real, ["kind", "made"], "left").withColumn("clash", (F.col("place") > 1) | F.col("real").isNotNull())
        checked = stage(checked.select("kind", "canon", "match", "attempt", "clash"), "attempts")
        discard(held)
        held = checked
        if checked.where("clash").isEmpty():
            return checked
        named = checked.select("kind", "canon", "match", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still clash; the formats found leave too few of them")


def _rewritten(text: Column, found: Column, pattern: Column, new: Column) -> Column:
    """The text with its matches replaced by ``new``, in order."""
    joined = F.concat_ws("", F.transform(F.split(text, pattern, -1), lambda s, i: F.concat(s, F.coalesce(F.get(new, i), F.lit("")))))
    return F.when(F.size(found) > 0, joined).otherwise(text)


def key_of(spark: SparkSession) -> str:
    """The configured key, else one drawn for this call."""
    return spark.conf.get(KEY, None) or os.environ.get("WEIRFLOW_SURROGATE_KEY") or token_hex(32)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", entities: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text, and the number of entities replaced."""
    own = [c for c in docs.columns if c not in ("n_entities", "entities")]

    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    found, pattern, rid, new = map(fresh, ("_found", "_pattern", "_rid", "_new"))
    kept = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in own))
    rows = stage(with_entities(kept, text_col, found, pattern).withColumn(rid, F.monotonically_increasing_id()), "texts")
    tried = attempts(found_entities(rows, found), key)
    again = tried.where("attempt > 0").select("kind", "canon", "attempt")
    text, its = F.col(f"`{text_col}`"), F.col(found)
    count = F.coalesce(F.size(F.filter(its, lambda e: e["kind"].isNotNull())), F.lit(0)).alias("n_entities")
    last = [its.alias("entities")] if entities else []
    if again.count() <= CONSTANTS:
        later = {(r.kind, r.canon): r.attempt for r in again.collect()}
        known = F.create_map(*(F.lit(x) for (k, c), a in sorted(later.items()) for x in (f"{k}\x1f{c}", a))) if later else None
        attempt = lambda e: F.lit(0) if known is None else F.coalesce(known[F.concat_ws("\x1f", e["kind"], e["canon"])], F.lit(0))
        made = rows.withColumn(new, F.transform(its, lambda e: surrogate(key, e["kind"], e["match"], e["canon"], attempt(e))))
    else:
        each = rows.select(rid, F.posexplode(its).alias("pos", "e")).select(rid, "pos", "e.kind", "e.match", "e.canon").join(bounded(again, again.count()), ["kind", "canon"], "left")
        one = each.select(rid, F.struct("pos", surrogate(key, F.col("kind"), F.col("match"), F.col("canon"), F.coalesce("attempt", F.lit(0))).alias("new")).alias("x"))
        made = rows.join(one.groupBy(rid).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["new"]).alias(new)), rid, "left")
    return made.withColumn(text_col, _rewritten(text, its, F.col(pattern), F.col(new))).select(*(F.col(f"`{c}`") for c in own), count, *last)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    out = pseudonymise(table(spark, sf_dir, "documents"), key_of(spark), entities=True)

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("entities", lambda e: e["kind"] == kind)), F.lit(0)).alias(f"n_{kind}")

    return out.select("doc_id", "text", "n_entities", *map(count, PATTERNS))


QUERIES = {"op7_surrogates": op7_surrogates}
SQL: dict[str, str] = {}
