"""Synthesis of labelled records: slot generators whose values agree, rendering with offsets, and distinct texts by rounds.

Every draw is a hash of (seed, row, attempt, slot, occurrence, number): counter-based streams without state, the same for any partitioning, and each value can be made
again alone. The n-th name, tax code, birth date, town, province and e-mail address of a record belong to one person: they are made from the
same draws. What a template doesn't name isn't evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import let
from ..sources.scratch import release, written
from .dataset import PLATE_LETTERS

PIECE = "array<struct<text:string,label:string>>"
SLOT = r"\{\w+\}"


@dataclass(frozen=True)
class Lists:
    """What names and places are drawn from. Own short lists; give longer ones for real use (towns: name, cadastral code, province)."""

    male: tuple[str, ...] = ("Aldo", "Bruno", "Carlo", "Dario", "Elio", "Fabrizio", "Giulio", "Ivano", "Luca", "Matteo", "Nicolò", "Oreste", "Piero", "Renato", "Saverio", "Tullio")
    female: tuple[str, ...] = ("Agata", "Bianca", "Carla", "Dora", "Elsa", "Fiorella", "Gaia", "Irma", "Lidia", "Marta", "Nives", "Olga", "Perla", "Rosa", "Silvia", "Zoe")
    surnames: tuple[str, ...] = ("Abate", "Bassi", "Cattaneo", "D'Angelo", "Èboli", "Fabbri", "Gallo", "Leone", "Mancini", "Neri", "Orsini", "Pace", "Riva", "Serra", "Testa", "Ungaro", "Villa", "Zanetti", "De Rosa", "Lo Monaco")
    towns: tuple[tuple[str, str, str], ...] = (
        ("Roma", "H501", "RM"), ("Milano", "F205", "MI"), ("Napoli", "F839", "NA"), ("Torino", "L219", "TO"), ("Palermo", "G273", "PA"), ("Genova", "D969", "GE"), ("Bologna", "A944", "BO"), ("Firenze", "D612", "FI"),
        ("Bari", "A662", "BA"), ("Catania", "C351", "CT"), ("Venezia", "L736", "VE"), ("Verona", "L781", "VR"), ("Padova", "G224", "PD"), ("Trieste", "L424", "TS"))
    streets: tuple[str, ...] = ("Via Roma", "Via Mazzini", "Corso Italia", "Piazza Dante", "Viale Europa", "Via dei Mille", "Largo Augusto", "Via San Marco")
    courts: tuple[str, ...] = ("Tribunale di", "Corte d'Appello di", "Giudice di Pace di")
    stems: tuple[str, ...] = ("Aurora", "Borea", "Cometa", "Dedalo", "Edera", "Fenice", "Ginepro", "Orione", "Perseo", "Quercia")
    forms: tuple[str, ...] = ("S.r.l.", "S.p.A.", "S.n.c.", "S.a.s.", "Soc. Coop.", "Ltd", "GmbH", "SARL", "B.V.", "Inc.")
    kinds: tuple[str, ...] = ("Consorzio", "Fondazione", "Cooperativa", "Associazione", "Studio Legale", "Banca")
    separators: tuple[str, ...] = (", ", "; ", " - ", " e ", "\n- ")


@dataclass(frozen=True)
class Stream:
    """Draws of one slot occurrence; `who` names the slot or the person."""

    seed: int
    row: Column
    attempt: Column
    occurrence: Column
    who: str

    def draw(self, k: str) -> Column:
        return F.xxhash64(F.lit(self.seed), self.row, self.attempt, F.lit(self.who), self.occurrence, F.lit(k))

    def below(self, n: int, k: str) -> Column:
        return F.pmod(self.draw(k), F.lit(n)).cast("int")

    def between(self, a: int, b: int, k: str) -> Column:
        """A whole number from a to b, both included (up to 64 bits wide)."""
        return F.pmod(self.draw(k), F.lit(b - a + 1)) + a

    def pick(self, options, k: str) -> Column:
        return F.get(F.array(*map(F.lit, options)), self.below(len(options), k))

    def chance(self, percent: int, k: str) -> Column:
        return self.below(100, k) < percent

    def symbols(self, alphabet: str, n: int, k: str) -> Column:
        return F.concat(*[F.substring(F.lit(alphabet), self.below(len(alphabet), f"{k}{i}") + 1, F.lit(1)) for i in range(n)])

    def digits(self, n: int, k: str) -> Column:
        return F.lpad(self.between(0, 10**n - 1, k).cast("string"), n, "0")


@dataclass(frozen=True)
class Person:
    """The fields of one person, all from the same stream."""

    s: Stream
    lists: Lists = field(default_factory=Lists)

    def male(self) -> Column:
        return self.s.chance(50, "sex")

    def sex(self) -> Column:
        return F.when(self.male(), "M").otherwise("F")

    def given(self) -> Column:
        return F.when(self.male(), self.s.pick(self.lists.male, "given")).otherwise(self.s.pick(self.lists.female, "given"))

    def surname(self) -> Column:
        return self.s.pick(self.lists.surnames, "surname")

    def birth(self) -> tuple[Column, Column, Column]:
        return self.s.between(1955, 2005, "year").cast("int"), self.s.between(1, 12, "month").cast("int"), self.s.between(1, 28, "day").cast("int")

    def town(self, i: int) -> Column:
        return self.s.pick([t[i] for t in self.lists.towns], "town")

    def names(self) -> tuple[Column, Column, Column]:
        """Whether the surname comes first, then both names in order."""
        turned = self.s.chance(30, "order")
        return turned, F.when(turned, self.surname()).otherwise(self.given()), F.when(turned, self.given()).otherwise(self.surname())

    def code(self) -> Column:
        y, m, d = self.birth()
        omocode = F.when(self.s.chance(5, "omocode"), self.s.between(1, 7, "omocodes")).otherwise(0)
        return checks.tax_code(self.given(), self.surname(), self.sex(), y, m, d, self.town(1), omocode)

    def mail(self, domain: str) -> Column:
        plain = lambda c: F.lower(checks.letters_only(c))
        return F.concat(plain(self.given()), F.lit("."), plain(self.surname()), F.lit(f"@{domain}"))


def _pieces(*parts: tuple[Column | str, str | None]) -> Column:
    return F.array(*[F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(label).cast("string").alias("label")) for t, label in parts]).cast(PIECE)


def _full_name(p: Person) -> Column:
    turned, a, b = p.names()
    label = lambda first: F.when(turned == F.lit(first), "SURNAME").otherwise("GIVENNAME")
    piece = lambda t, lab: F.struct(t.alias("text"), lab.alias("label"))
    return F.array(piece(a, label(True)), piece(F.lit(" "), F.lit(None).cast("string")), piece(b, label(False))).cast(PIECE)


def _role(p: Person, label: str) -> Column:
    _, a, b = p.names()
    return _pieces((F.concat(a, F.lit(" "), b), label))


def _org(s: Stream, lists: Lists) -> Column:
    stem, form = s.pick(lists.stems, "stem"), s.pick(lists.forms, "form")
    style = s.below(100, "style")
    form = F.when(style < 45, form).when(style < 60, F.upper(form)).when(style < 75, F.lower(form)).otherwise(F.replace(form, F.lit("."), F.lit("")))
    kind = s.below(100, "kind")
    name = F.when(kind < 45, F.concat_ws(" ", stem, form)).when(kind < 60, F.concat_ws(" ", s.pick(lists.kinds, "sort"), stem)).when(kind < 72, F.concat(s.pick(lists.surnames, "a"), F.lit(" & "), s.pick(lists.surnames, "b")))
    name = name.when(kind < 84, F.concat_ws(" ", s.symbols(checks.SYMBOLS[10:], 3, "acronym"), form)).otherwise(stem)
    return _pieces((name, "ORG"))


def plate(s: Stream, spaces: int = 35, hyphens: int = 15, lower: int = 0) -> Column:
    """A plate: two letters, three digits, two letters; shares of printed forms in percent."""
    parts = [s.symbols(PLATE_LETTERS, 2, "first"), s.between(100, 999, "number").cast("string"), s.symbols(PLATE_LETTERS, 2, "last")]
    style = s.below(100, "style")
    value = F.when(style < spaces, F.concat_ws(" ", *parts)).when(style < spaces + hyphens, F.concat_ws("-", *parts)).otherwise(F.concat(*parts))
    return F.when(s.chance(lower, "lower"), F.lower(value)).otherwise(value) if lower else value


def _list(s: Stream, least: int, most: int, lists: Lists, each: Callable[[Column], Column]) -> Column:
    n = s.between(least, most, "n").cast("int")
    sep = F.struct(s.pick(lists.separators, "separator").alias("text"), F.lit(None).cast("string").alias("label"))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.when(i > 0, F.array(sep).cast(PIECE)).otherwise(F.array().cast(PIECE)), each(s.occurrence * 8 + i))))


def generators(seed: int, row: Column, attempt: Column, lists: Lists | None = None) -> dict[str, Callable[[Column], Column]]:
    """slot: a function of the occurrence that gives its pieces (text, label; label null for plain text)."""
    lists = lists or Lists()
    stream = lambda who: lambda o: Stream(seed, row, attempt, o, who)
    person = lambda who: lambda o: Person(stream(who)(o), lists)
    main, s = person("main"), stream
    date = lambda p: F.concat_ws("/", *[F.lpad(c.cast("string"), n, "0") for c, n in zip(p.birth()[::-1], (2, 2, 4), strict=True)])
    alnum = checks.SYMBOLS

    def address(o):
        x = s("address")(o)
        town = lambda i: x.pick([t[i] for t in lists.towns], "town")
        return _pieces((x.pick(lists.streets, "street"), "STREET"), (" ", None), (x.between(1, 250, "house").cast("string"), "BUILDINGNUM"), (", ", None), (F.concat(x.between(10, 98, "zone").cast("string"), x.digits(3, "zip")), "ZIPCODE"), (" ", None), (town(0), "CITY"), (" (", None), (town(2), "PROVINCE"), (")", None))

    def amount(o):
        euros = s("amount")(o).between(500, 250_000, "euros")
        return _pieces((F.concat(F.lit("€ "), F.translate(F.format_number(euros, 0), ",", "."), F.lit(",00")), "AMOUNT"))

    def register(x, label, short):
        return _pieces((F.when(x.chance(40, "bare") & F.lit(not short), x.between(10_000, 999_999, "n").cast("string")).otherwise(F.concat(x.between(100, 9999, "n").cast("string"), F.lit("/"), x.between(2018, 2025, "year").cast("string"))), label))

    def policy(o):
        x, kind = s("policy")(o), s("policy")(o).below(100, "kind")
        return _pieces((F.when(kind < 45, x.digits(10, "n")).when(kind < 75, F.concat(x.symbols(alnum[10:], 2, "branch"), F.lit("/"), x.digits(7, "n"))).otherwise(F.concat(x.digits(3, "a"), F.lit("-"), x.digits(6, "b"))), "POLIZZA"))

    def company_number(o):
        x = s("matricola")(o)
        d = x.digits(10, "n")
        return _pieces((F.when(x.chance(70, "plain"), d).otherwise(F.concat(F.substring(d, 1, 4), F.lit("/"), F.substring(d, 5, 6))), "MATRICOLA"))

    def land(o):
        x = s("catasto")(o)
        n = lambda m, k: x.between(1, m, k).cast("string")
        return _pieces(("Foglio ", None), (n(200, "sheet"), "CATASTO"), (", particella ", None), (n(999, "parcel"), "CATASTO"), (", sub. ", None), (n(30, "sub"), "CATASTO"))

    names = lambda o: _full_name(person("list")(o))
    firms = lambda o: _org(s("firms")(o), lists)
    return {
        "FULLNAME": lambda o: _full_name(main(o)), "JUDGE": lambda o: _role(person("judge")(o), "GIUDICE"), "LAWYER": lambda o: _role(person("lawyer")(o), "AVVOCATO"), "PLAINTIFF": lambda o: _role(person("plaintiff")(o), "ATTORE"),
        "DEFENDANT": lambda o: _role(person("defendant")(o), "CONVENUTO"), "WITNESS": lambda o: _role(person("witness")(o), "TESTIMONE"), "CF": lambda o: _pieces((main(o).code(), "CF")), "PIVA": lambda o: _pieces((checks.vat_number(s("piva")(o).digits(10, "n")), "PIVA")),
        "IBAN": lambda o: _pieces((checks.iban_it(F.concat(s("iban")(o).digits(11, "a"), s("iban")(o).digits(11, "b"))), "IBAN")), "ADDRESS": address, "EMAIL": lambda o: _pieces((main(o).mail("example.it"), "EMAIL")), "PEC": lambda o: _pieces((main(o).mail("pec.it"), "PEC")),
        "PHONE": lambda o: _pieces((F.concat(F.lit("+39 3"), s("phone")(o).digits(2, "a"), F.lit(" "), s("phone")(o).between(1_000_000, 9_999_999, "b").cast("string")), "TELEPHONENUM")), "AMOUNT": amount, "RG": lambda o: register(s("rg")(o), "RG", True),
        "TRIBUNAL": lambda o: _pieces((F.concat_ws(" ", s("court")(o).pick(lists.courts, "kind"), s("court")(o).pick([t[0] for t in lists.towns], "town")), None)), "TARGA": lambda o: _pieces((plate(s("plate")(o)), "TARGA")),
        "IDCARD": lambda o: _pieces((F.concat(F.lit("CA"), s("idcard")(o).digits(5, "n"), s("idcard")(o).symbols(PLATE_LETTERS, 2, "l")), "IDCARDNUM")),
        "DRIVING": lambda o: _pieces((F.concat(s("driving")(o).symbols(PLATE_LETTERS, 2, "a"), s("driving")(o).digits(7, "n"), s("driving")(o).symbols(PLATE_LETTERS, 1, "b")), "DRIVERLICENSENUM")),
        "CITY": lambda o: _pieces((main(o).town(0), "CITY")), "PROVINCE": lambda o: _pieces((main(o).town(2), "PROVINCE")), "DATE": lambda o: _pieces((date(main(o)), "DATE")), "ORG": lambda o: _org(s("org")(o), lists), "DOCID": lambda o: register(s("docid")(o), "DOCID", False), "CATASTO": land,
        "CONTO": lambda o: _pieces((s("conto")(o).digits(12, "n"), "CONTO")), "CIG": lambda o: _pieces((s("cig")(o).symbols(alnum, 10, "n"), "CIG")),
        "CUP": lambda o: _pieces((F.concat(s("cup")(o).symbols(alnum[10:], 1, "a"), s("cup")(o).digits(2, "b"), s("cup")(o).symbols(alnum[10:], 2, "c"), s("cup")(o).digits(10, "d")), "CUP")), "POLIZZA": policy, "MATRICOLA": company_number,
        "NAMELIST": lambda o: _list(s("namelist")(o), 2, 7, lists, names), "ORGLIST": lambda o: _list(s("orglist")(o), 2, 6, lists, firms), "MIXEDLIST": lambda o: _list(s("mixedlist")(o), 3, 7, lists, lambda i: F.when(s("mixed")(i).chance(50, "kind"), names(i)).otherwise(firms(i))),
    }


def rendered(template: Column, made: dict[str, Callable[[Column], Column]]) -> Column:
    """(text, entities: value, label, start, end): each slot of the template replaced by its pieces; the n-th occurrence of a slot has its own draws. Slots that aren't in `made` stay.

    Give only the slots that templates name: each becomes part of the plan.
    """

    def pieces(names, parts):
        def one(s, i):
            occurrence = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == s))
            value = F.when(F.lit(False), F.array().cast(PIECE))
            for name, f in made.items():
                value = value.when(s == name, f(occurrence))
            value = value.otherwise(F.array(F.struct(F.concat(F.lit("{"), s, F.lit("}")).alias("text"), F.lit(None).cast("string").alias("label"))).cast(PIECE))
            return F.concat(F.array(F.struct(F.get(parts, i).alias("text"), F.lit(None).cast("string").alias("label"))).cast(PIECE), value)

        tail = F.array(F.struct(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("text"), F.lit(None).cast("string").alias("label"))).cast(PIECE)
        return F.concat(F.flatten(F.transform(names, one)), tail)

    def placed(p):
        start = F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, F.lit(-1)) + F.length(x["text"])))

        def spans(at):
            each = F.transform(p, lambda x, i: F.struct(x["text"].alias("value"), x["label"].alias("label"), F.get(at, i).alias("start"), F.get(at, i + 1).alias("end")))
            return F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"), F.filter(each, lambda e: e["label"].isNotNull()).alias("entities"))

        return let(start, spans)

    cut = F.struct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)).alias("names"), F.split(template, SLOT, -1).alias("parts"))
    return let(let(cut, lambda c: pieces(c["names"], c["parts"])), placed)


def category_mix(rows: DataFrame, key: str, shares: dict[str, float], salt: str) -> DataFrame:
    """rows with `category`: exactly floor(n * share) rows of each but the last category, which takes the rest, in a salted order."""
    from .dataset import salted
    from .scan import running

    n = rows.count()
    out = running(rows.withColumn("_order", salted(salt, F.col(key))), [], ["_order", key], "_place")
    at, case, names = 0, None, list(shares)
    for name in names[:-1]:
        at += int(n * shares[name])
        case = F.when(F.col("_place") <= at, name) if case is None else case.when(F.col("_place") <= at, name)
    return out.withColumn("category", case.otherwise(names[-1]) if case is not None else F.lit(names[-1])).drop("_order", "_place")


def distinct_by_rounds(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], text: str = "text", rounds: int = 20) -> DataFrame:
    """make(rows with a column `attempt`) with one distinct text for every row of `rows`: of rows that draw the same text the smallest key keeps it, and
    the others draw again with the next attempt, never a text that is kept already. An error if some still collide after `rounds` attempts.

    A round costs one aggregation and one anti-join of its own texts; what is redrawn shrinks by the share of collisions. key must be unique.
    """
    kept, left, attempt = None, rows, 0
    while True:
        made = written(make(left.withColumn("attempt", F.lit(attempt))).drop("attempt"), "drawn")
        firsts = made.groupBy(F.col(text).alias("_text")).agg(F.min(key).alias("_key"))
        if kept is not None:
            firsts = firsts.join(kept.select(F.col(text).alias("_text")), "_text", "left_anti")
        fresh = made.join(firsts.select(F.col("_key").alias(key)), key, "left_semi")
        kept = written(fresh if kept is None else kept.unionByName(fresh), "kept")
        left = written(left.join(kept.select(key), key, "left_anti"), "to-draw")
        release(made)
        if left.isEmpty():
            return kept
        attempt += 1
        if attempt >= rounds:
            raise ValueError(f"{left.count()} rows still draw taken texts after {rounds} attempts: the templates have too few different fills")


def synthesise(rows: DataFrame, key: str, templates: DataFrame, seed: int, lists: Lists | None = None, extra: dict[str, Callable[[Stream], Column]] | None = None, rounds: int = 20) -> DataFrame:
    """One record (key, category, template_id, text, entities) with a text of its own for each row (key, category).

    templates: category, template_id, template; of a category's templates each row draws one (a bounded list: it is broadcast). extra: more slots, each a function of its stream that gives the value of an unlabelled piece or
    an array of pieces.
    """
    n = templates.count()
    if n > 10_000:
        raise ValueError(f"{n} templates")
    used = {r[0] for r in templates.select(F.explode(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1)))).distinct().collect()}
    row, attempt = F.col(key), F.col("attempt")
    made = generators(seed, row, attempt, lists)
    for slot, f in (extra or {}).items():
        made[slot] = lambda o, f=f, slot=slot: f(Stream(seed, row, attempt, o, slot))
    which = F.pmod(F.xxhash64(F.lit(seed), row, attempt, F.lit("template")), F.size("_options")).cast("int")
    record = rendered(F.col("_t")["template"], {k: f for k, f in made.items() if k in used})
    listed = templates.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("template_id", "template"))).alias("_options"))
    names = [c for c in rows.columns if c in (key, "category")]

    def make(left: DataFrame) -> DataFrame:
        d = left.join(F.broadcast(listed), "category").withColumn("_t", F.get("_options", which)).withColumn("_r", record)
        return d.select(*names, "attempt", F.col("_t")["template_id"].alias("template_id"), "_r.text", "_r.entities")

    return distinct_by_rounds(rows.select(*names), key, make, rounds=rounds)


def record_fault(text: Column, entities: Column) -> Column:
    """What is wrong with a record, or null: a value that isn't at its place, overlapping entities, a false tax code, VAT number or IBAN."""
    misplaced = F.exists(entities, lambda e: F.substring(text, e["start"] + 1, e["end"] - e["start"]) != e["value"])
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    overlap = let(ordered, lambda o: F.exists(F.transform(o, lambda e, i: F.coalesce(F.get(o, i - 1)["end"] > e["start"], F.lit(False))), lambda x: x))
    false = lambda label, ok: F.exists(entities, lambda e: (e["label"] == label) & ~ok(e["value"]))
    return F.coalesce(
        F.when(misplaced, "offset"), F.when(overlap, "overlap"), F.when(false("CF", checks.cf_ok), "tax code"), F.when(false("PIVA", checks.piva_ok), "VAT number"), F.when(false("IBAN", checks.iban_ok), "IBAN"))


def injected_rows(pool: DataFrame, key: str, snippets: DataFrame, per_tag: int, seed: int, several: int = 1, lists: Lists | None = None) -> DataFrame:
    """per_tag rows (tag, number, key, text, entities) for each tag: texts of the pool, dealt out in turn, with `several` filled snippets of the tag put in behind sentences.

    pool: key, text, entities (label, start, end). snippets: tag, snippet (a template); of a tag's snippets each insertion draws one. The places are drawn among the text's sentence ends; where
    there are fewer than `several`, places are used again.
    """
    from .dataset import round_robin, sentence_ends, with_insertions

    listed = snippets.groupBy("tag").agg(F.sort_array(F.collect_list("snippet")).alias("_options"))
    used = {r[0] for r in snippets.select(F.explode(F.regexp_extract_all("snippet", F.lit(r"\{(\w+)\}"), F.lit(1)))).distinct().collect()}
    rows = snippets.select("tag").distinct().select("tag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_tag - 1).cast("long"))).alias("number"))
    rows = rows.withColumn("_order", F.struct("tag", "number"))
    rows = round_robin(rows, pool.select(F.col(key), "text", "entities"), "_order", key).drop("_order").join(F.broadcast(listed), "tag")
    row = F.concat_ws(":", "tag", "number")
    rows = rows.withColumn("_spots", sentence_ends(F.col("text"), F.col("entities")))
    insertions = []
    for k in range(several):
        at = lambda what, size, k=k: F.get(F.col(what), F.pmod(F.xxhash64(F.lit(seed), row, F.lit(f"{what}{k}")), F.size(what)).cast("int"))
        made = {s: f for s, f in generators(seed, row, F.lit(k), lists).items() if s in used}
        rows = rows.withColumn(f"_filled{k}", rendered(F.concat(at("_options", 0), F.lit(" ")), made))
        f = F.col(f"_filled{k}")
        insertions.append(F.struct(at("_spots", 0).alias("at"), f["text"].alias("text"), F.transform(f["entities"], lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"))).alias("entities")))
    plain = F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end")))
    rows = rows.withColumn("_whole", with_insertions(F.col("text"), plain, F.array(*insertions)))
    return rows.select("tag", "number", key, "_whole.text", "_whole.entities")
