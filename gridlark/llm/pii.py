"""Surrogate generation for personal data, in DataFrame functions only.

Detected entities get surrogates of their own type, made from a keyed hash of what the mention stands for:

* e-mail addresses: letters and digits of the name and first label, ``example`` and the old top-level domain;
* telephone, card and social security numbers: digits in the same grouping, with the country code, a card's
  first digit and a valid check digit kept;
* IPv4 addresses; access keys (with their prefix), tokens, passwords and hexadecimal secrets: signs of the
  same class at each place, key names and hexadecimal signs in either case;
* names after a title: a given name of the title's gender and a family name, in the script of the name.

The same entity gets the same surrogate everywhere, however it is written (coreference). A name that a document
has after a title is replaced in the rest of that document too, where it stands as a word of its own, so
"Dr. Anna Smith" and "Smith" follow "Mrs Anna Smith". Different entities must keep different surrogates: the
distinct entities of the corpus are checked for two with one surrogate, and for surrogates that are real
entities here; all but one are hashed again with a higher attempt until no clash is left. Each round is about
the entities still open only. From attempt ``GROW`` on, a surrogate is one syllable or sign longer at each
attempt, so the space of a format that is full, or too small, outgrows its entities. Only the entities that
needed a further attempt are joined back to their documents; all others are computed where the text is read.

No pattern recurses with the text, and the work grows as a text's length, times the logarithm of its number of names.
Null texts stay null; texts without entities are unchanged. Repeated rows are treated alike, since
surrogates depend on entities only. Empty tables give no rows. All columns of the input are returned; ``pii_count`` is this
operator's own, and replaces one of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, let, stored

KEY = "surrogates-1"
#: The attempt from which on surrogates grow.
GROW = 8
#: For secrets without letters and digits.
MARKS = "!#$%&*+-.:;?@^_~"
MALE, FEMALE = ("Mr", "Herr", "Sr", "г-н"), ("Mrs", "Ms", "Frau", "Mme", "Sra", "г-жа")
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE, key=len, reverse=True)) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A domain ends with the letters of its last label that starts with two letters. Groups repeat possessively, as others recurse with the text.
_TO_TOP = r"[A-Za-z0-9-]*+(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2,}+"
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:{_TO_TOP})++"
IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.[0-9])"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"
CARD = r"(?<!\w)[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?!\w)"
SSN = r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)"
ACCESS = r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)"
SECRET = r"(?<=(?i:password|passwd|secret|token|api_key)=)[^\s\x22']+|(?<=(?i:password|passwd|secret|token|api_key) = \x22)[^\s\x22]+|(?<!\w)[0-9A-Fa-f]{32,64}(?!\w)"
PERSON = rf"(?<!\w){TITLE} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
POSSESSIVE = "'s$"
ENTITY = "|".join((EMAIL, IP, PHONE, CARD, SSN, ACCESS, SECRET, PERSON))
#: What a text with an entity has at least: one of these signs or runs, or a title before a capital letter.
SIGNS = "[0-9@=\x22]|A[KS]IA|[A-Fa-f]{32}"
TITLED = TITLE + r" \p{Lu}"
#: Syllables of surrogate names, by script, and endings by gender.
SYLLABLES = {"latin": "ba be da do fe ga ka la le li ma mi na no pa ra re ri sa so ta te va vi".split(), "cyrillic": "ба ве да до ка ла ле ли ма ми на но па ра ре ри са со та те ва ви га фе".split()}
ENDINGS = {"latin": {"m": ["n", "ro", "us"], "f": ["na", "ra", "ia"], "s": ["ler", "mond", "ström"]}, "cyrillic": {"m": ["н", "р", "слав"], "f": ["на", "ра", "ия"], "s": ["енко", "ич", "ук"]}}


def bytes_of(hex_: Column) -> Column:
    """The first 62 bytes of a digest in hexadecimal."""
    return F.transform(F.sequence(F.lit(0), F.lit(61)), lambda i: F.conv(F.substring(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def byte(bytes_: Column, i: Column | int) -> Column:
    """The i-th byte, from 0; it starts again after 62."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.get(bytes_, i % 62)


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email").when(whole(IP), "ip").when(whole(PHONE), "phone").when(whole(SSN), "ssn").when(whole(CARD), "card")
        .when(whole(ACCESS), "access").when(m.rlike(rf"^{TITLE} "), "person").when(m.rlike("^(?:[0-9a-f]+|[0-9A-Fa-f]{32,})$"), "hex").otherwise("secret")
    )


def units(m: Column) -> Column:
    """What a mention stands for: an array of (kind, name)."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    unit = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))

    def of(kind: Column) -> Column:
        # digests are the same value in either case; a short secret of hexadecimal signs is not
        name = F.when(kind.isin("email", "hex"), F.lower(m)).when(kind == "phone", F.substring(digits, -10, 10)).when(kind.isin("card", "ssn"), digits).otherwise(m)
        parts = F.split(m, " ")
        gender = F.when(F.regexp_replace(parts[0], r"\.", "").isin(*MALE), "m").otherwise("f")
        last, given = F.lower(F.regexp_replace(F.element_at(parts, -1), POSSESSIVE, "")), F.lower(parts[1])
        person = F.when(F.size(parts) > 2, F.array(unit(F.concat(F.lit("given_"), gender), given), unit(F.lit("family"), last))).otherwise(F.array(unit(F.lit("family"), last)))
        return F.when(kind == "person", person).otherwise(F.array(unit(kind, name)))

    return let(kind_of(m), of)


def luhn(digits: Column) -> Column:
    """The sum that a card number's check digit makes a multiple of 10."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    more = F.greatest(attempt - (GROW - 1), F.lit(0))
    only_marks = (kind == "secret") & ~name.rlike(r"[\p{L}0-9]")

    def of(h: Column) -> Column:
        once = F.struct(F.right(h, more).alias("end"), bytes_of(h).alias("bytes"), only_marks.alias("marks"))
        return let(once, lambda x: made(x["end"], x["bytes"], x["marks"]))

    def made(end: Column, h: Column, marks: Column) -> Column:
        digits, letters = F.translate(end, "abcdef", "012345"), F.translate(end, "0123456789", "ghijklmnop")

        def sign(c: Column, b: Column) -> Column:
            pick = lambda alphabet: F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))
            return (
                F.when((kind == "hex"), pick("0123456789abcdef")).when(marks, pick(MARKS))
                .when((kind == "access") & (c.between("0", "9") | c.between("A", "Z")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
                .when(c.between("0", "9"), pick("0123456789")).when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c < "\x7f", c).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
            )

        def like(text: Column, keep: int = 0, off: int = 0) -> Column:
            one = lambda c, i: F.when(i < keep, c).otherwise(sign(c, byte(h, i + off)))
            return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))

        local, domain = F.substring_index(name, "@", 1), F.substring_index(name, "@", -1)
        email = F.concat(like(local), letters, F.lit("@"), like(F.substring_index(domain, ".", 1), off=31), F.lit(".example."), F.substring_index(domain, ".", -1))
        ip = F.concat_ws(".", *[(byte(h, i) % 254 + 1).cast("string") for i in range(4)])
        ip = F.when(more > 0, F.concat_ws(":", ip, digits)).otherwise(ip)
        lead = lambda i: (byte(h, i) % 8 + 2).cast("string")  # noqa: E731  no area code starts with 0 or 1
        phone = let(like(name), lambda s: F.concat(lead(0), F.substring(s, 2, 2), lead(3), F.substring(s, 5, 99), digits))

        def card(s: Column) -> Column:
            body = F.substring(s, F.lit(1), F.length(s) - 1)
            check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
            return F.when(luhn(name) % 10 == 0, F.concat(body, check)).otherwise(s)

        def person(script: str, g: str) -> Column:
            part = lambda i: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[script]]), byte(h, i) % len(SYLLABLES[script]) + 1)
            last = F.element_at(F.array(*[F.lit(x) for x in ENDINGS[script][g]]), byte(h, 9) % 3 + 1)
            longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: part(i + 9)), "")).otherwise(F.lit(""))
            return F.concat(part(0), part(1), F.when(byte(h, 8) % 2 == 0, part(2)).otherwise(F.lit("")), longer, last)

        cyrillic = name.rlike(r"\p{IsCyrillic}")
        names = F.lit(None).cast("string")
        for k, g in (("given_m", "m"), ("given_f", "f"), ("family", "s")):
            names = F.when(kind == k, F.when(cyrillic, person("cyrillic", g)).otherwise(person("latin", g))).otherwise(names)
        return (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", let(F.concat(like(name, 1), digits), card))
            .when(kind == "access", F.concat(like(name, 4), F.upper(letters))).when(kind.isin("given_m", "given_f", "family"), names)
            .when(kind == "ssn", F.concat(like(name), digits)).when(kind == "hex", F.concat(like(name), end)).otherwise(F.concat(like(name), F.when(marks, F.translate(end, "0123456789abcdef", MARKS)).otherwise(letters)))
        )

    return let(F.sha2(F.concat_ws("|", F.lit(key), kind, name, attempt.cast("string")), 512), of)


def poured(m: Column, digits: Column, n: Column) -> Column:
    """The digits of a surrogate for the last ``n`` ones of a mention, in its grouping; further ones come after."""
    skip = F.length(F.regexp_replace(m, "[^0-9]", "")) - n
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (acc["k"] >= skip), F.substring(digits, acc["k"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.concat(F.aggregate(F.split(m, ""), start, step, lambda acc: acc["out"]), F.substring(digits, n + 1, F.length(digits)))


def cased(m: Column, s: Column) -> Column:
    """``s`` with a capital wherever the mention has one."""
    one = lambda c, of: F.when(of.between("A", "Z"), F.upper(c)).otherwise(c)  # noqa: E731  further signs of s stay
    return F.array_join(F.zip_with(F.split(s, ""), F.split(m, ""), lambda c, of: F.when(c.isNull(), "").when(of.isNull(), c).otherwise(one(c, of))), "")


def chosen(u: Column, again: Column, key: str) -> Column:
    """A unit's surrogate; ``again`` is an array of (kind, name, attempt) for units not at attempt 0."""
    own = F.filter(again, lambda a: (a["kind"] == u["kind"]) & (a["name"] == u["name"]))
    return surrogate(u["kind"], u["name"], F.coalesce(F.get(own, 0)["attempt"], F.lit(0)), key)


def rendered(m: Column, again: Column, key: str) -> Column:
    """A mention's replacement; ``again`` is an array of (kind, name, attempt) for units not at attempt 0."""

    def of(us: Column) -> Column:
        def write(s: Column) -> Column:
            kind, first = F.get(us, 0)["kind"], F.get(s, 0)
            names = F.concat(F.concat_ws(" ", F.element_at(F.split(m, " "), 1), F.transform(s, F.initcap)), F.regexp_extract(m, POSSESSIVE, 0))
            upper = (m == F.upper(m)) & (m != F.lower(m))
            return (
                F.when(kind.isin("given_m", "given_f", "family"), names).when(kind.isin("phone", "card", "ssn"), poured(m, first, F.length(F.get(us, 0)["name"])))
                .when(kind.isin("email", "hex") & upper, F.upper(first)).when((kind == "hex") & (m != F.lower(m)), cased(m, first)).otherwise(first)
            )

        return let(F.transform(us, lambda u: chosen(u, again, key)), write)

    return let(units(m), of)


def known_names(ms: Column, again: Column, key: str) -> Column:
    """(word, surrogate) of the names that the mentions give, in order."""

    def of(m: Column) -> Column:
        parts = F.split(m, " ")

        def one(u: Column, i: Column) -> Column:
            return F.struct(F.regexp_replace(F.get(parts, i + 1), POSSESSIVE, "").alias("word"), F.initcap(chosen(u, again, key)).alias("s"))

        return F.transform(units(m), one)

    persons = F.filter(ms, lambda m: kind_of(m) == "person")
    return F.sort_array(F.array_distinct(F.flatten(F.transform(persons, of))))


#: A text as runs of signs that words are made of, and of others.
RUNS = r"[\p{L}\p{N}_'-]+|[^\p{L}\p{N}_'-]+"
#: Steps of a search among as many names as a text can hold.
STEPS = [1 << k for k in reversed(range(28))]


def renamed(text: Column, names: Column) -> Column:
    """(text, n): the names in a text between mentions replaced, and how many.

    Each word is looked up in the ordered names. Apostrophes are part of a name (O'Neil) or else end a word (Neil's).
    """
    steps = F.filter(F.array(*[F.lit(x) for x in STEPS]), lambda x: x <= F.size(names))

    def found(word: Column) -> Column:
        """The surrogate of a word, null if it is no name: the first entry that is not before it."""
        before = F.aggregate(steps, F.lit(0), lambda lo, x: F.when(F.coalesce(F.get(names, lo + x - 1)["word"] < word, F.lit(False)), lo + x).otherwise(lo))
        return let(F.get(names, before), lambda e: F.when(e["word"] == word, e["s"]))

    def one(run: Column) -> Column:
        plain = F.struct(run.alias("text"), F.lit(0).alias("n"))

        def parts(ps: Column) -> Column:
            new = F.transform(ps, lambda p: F.struct(p.alias("p"), found(p).alias("s")))
            return let(new, lambda x: F.struct(F.array_join(F.transform(x, lambda y: F.coalesce(y["s"], y["p"])), "'").alias("text"), F.size(F.filter(x, lambda y: y["s"].isNotNull())).alias("n")))

        def owned(stem: Column) -> Column:
            """A name with an apostrophe inside, before a possessive."""
            named = lambda s: F.struct(F.concat(s, F.substring(run, F.length(stem) + 1, F.length(run))).alias("text"), F.lit(1).alias("n"))
            return let(found(stem), lambda s: F.when(s.isNotNull(), named(s)).otherwise(parts(F.split(run, "'"))))

        stem = F.regexp_replace(run, POSSESSIVE, "")
        whole = let(found(run), lambda s: F.when(s.isNotNull(), F.struct(s.alias("text"), F.lit(1).alias("n"))).otherwise(let(stem, owned)))
        return F.when(run.rlike(r"\p{Lu}"), whole).otherwise(plain)

    done = F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), one)
    return let(done, lambda x: F.struct(F.array_join(F.transform(x, lambda y: y["text"]), "").alias("text"), F.aggregate(x, F.lit(0), lambda n, y: n + y["n"]).alias("n")))


def mentions(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(SIGNS) | text.rlike(TITLED), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def space(kind: Column) -> Column:
    """Kinds whose entities can be mistaken for each other."""
    return F.when(kind == "hex", "secret").otherwise(kind)


def retried(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, name, attempt) of the entities whose first surrogate clashes; it ends, as surrogates grow."""
    found = docs.select(F.explode(mentions(F.col("text"))).alias("m")).select(F.explode(units(F.col("m"))).alias("u")).select("u.kind", "u.name")
    own = stored(found.distinct(), "pii-units", narrow=True)
    taken = own.select(space(F.col("kind")).alias("r_kind"), F.col("name").alias("r_name"))
    open_, settled = own.withColumn("attempt", F.lit(0)), []
    while True:
        made = stored(open_.withColumn("s", surrogate(F.col("kind"), F.col("name"), F.col("attempt"), key)), "pii-surrogates", narrow=True)
        # settled entities keep their surrogates; of open ones with the same surrogate, the first by name gets it
        place = W.partitionBy(space(F.col("kind")), "s").orderBy("name", "kind")
        x = made.withColumn("r", F.row_number().over(place)).join(taken.distinct(), (space(F.col("kind")) == F.col("r_kind")) & (F.col("s") == F.col("r_name")), "left")
        bad = (F.col("r") > 1) | F.col("r_name").isNotNull()
        if settled:
            used = settled[0]
            for t in settled[1:]:
                used = used.union(t)
            x = x.join(used.select(space(F.col("kind")).alias("u_kind"), F.col("s").alias("u_s")), (space(F.col("kind")) == F.col("u_kind")) & (F.col("s") == F.col("u_s")), "left")
            bad = bad | F.col("u_s").isNotNull()
        x = stored(x.select("kind", "name", "attempt", "s", bad.alias("bad")), "pii-attempts", narrow=True)
        drop_stored(made)
        settled.append(x.filter("not bad").select("kind", "name", "attempt", "s"))
        open_ = x.filter("bad").select("kind", "name", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            break
    again = settled[0].limit(0)
    for t in settled[1:]:
        again = again.union(t)
    return again.select("kind", "name", "attempt")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the text's entities replaced, and ``pii_count``, the number of mentions replaced."""
    again = retried(docs, key)
    kind = "array<struct<kind:string,name:string,attempt:int>>"
    x = docs
    if again.limit(1).count():
        a = again.select(F.col("kind").alias("a_kind"), F.col("name").alias("a_name"), "attempt")
        # a document is its id and its text, so that rows without an id, or with a common one, do not meet in one list
        per = docs.select("doc_id", F.xxhash64("text").alias("h"), F.explode(mentions(F.col("text"))).alias("m")).select("doc_id", "h", F.explode(units(F.col("m"))).alias("u"))
        per = per.join(a, (F.col("u.kind") == F.col("a_kind")) & (F.col("u.name") == F.col("a_name")))
        per = stored(per.groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("u.kind").alias("kind"), F.col("u.name").alias("name"), "attempt")).alias("__pii_again")), "pii-again")
        x = docs.join(per.select(F.col("doc_id").alias("__pii_doc"), F.col("h").alias("__pii_text"), "__pii_again"), F.col("doc_id").eqNullSafe(F.col("__pii_doc")) & (F.xxhash64(F.col("text")) == F.col("__pii_text")), "left")
        listed = F.coalesce("__pii_again", F.array().cast(kind))
    else:
        listed = F.array().cast(kind)
    text = F.col("text")

    def replaced(ms: Column) -> Column:
        def join(pieces: Column) -> Column:
            made = F.transform(ms, lambda m: rendered(m, listed, key))

            def with_names(names: Column) -> Column:
                plain = F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
                return F.when(F.size(names) > 0, F.transform(pieces, lambda p: renamed(p, names))).otherwise(plain)

            def put(between: Column, new: Column) -> Column:
                text = F.concat(F.array_join(F.transform(new, lambda m, i: F.concat(between[i]["text"], m)), ""), F.element_at(between, -1)["text"])
                n = F.size(ms) + F.aggregate(between, F.lit(0), lambda a, p: a + p["n"])
                return F.struct(text.alias("text"), n.cast("long").alias("n"))

            return let(let(known_names(ms, listed, key), with_names), lambda between: let(made, lambda new: put(between, new)))

        return F.when(F.size(ms) > 0, let(F.split(text, ENTITY, -1), join)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))

    done = x.withColumn("__pii_new", F.when(text.isNotNull(), let(mentions(text), replaced)))
    new = {"text": F.col("__pii_new.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__pii_new.n") > 0, F.length("__pii_new.text").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns if c != "pii_count"], F.coalesce("__pii_new.n", F.lit(0)).alias("pii_count"))
