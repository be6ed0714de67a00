"""Personal data: detected entities get keyed surrogates, in DataFrame operations only.

A surrogate follows from a key, the entity's type and its canonical form alone, so an entity has the same one in every
document and spelling (coreference). It keeps the type's format: digits become other digits, letters other letters of
their script and case, separators stay; card numbers and account numbers that satisfy their check digits still do,
addresses stay in range, mail domains become reserved ones. Names become names of the same script and gender, put
together from tables: given names by gender, surnames from stems and endings, with the endings that the gender has in
that script. Gender is told by the title, or by a given name that is in a table. The last word is the surname, the same
with and without given names before it, unless it stands alone and clashes.

A check over all entities finds surrogates that two of them share, or that are another's real value, and tries those
again with a counter until none is left, so that distinct entities stay distinct. Names and mail addresses that clash
WIDER times get a keyed suffix, in a mail address a label of the reserved domain, which grows with each further try. The
other types have as many surrogates as their format has values; where some still clash after LAST tries, as the format is
all but used up, the run fails.

Persons are found by a title before a capitalised name, or by a given name of the tables before a capitalised word.

Defined results: a null text stays null; an empty text stays empty; texts of any length are replaced whole; rows with
equal ids are treated each; other columns are kept whatever their names, but for pii, which is replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import forget, free_name, materialise

WIDER, LAST, SALTS = 6, 100, 16

#: Fixed patterns, tried in this order at each place.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
IBAN = r"(?=[A-Z]{2}\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
#: Fixed titles, by gender.
TITLES = {"m": "Mr|Monsieur|Herr|Señor|Sr|г-н|господин|κύριος", "f": "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra|г-жа|госпожа|κυρία"}
ALL_TITLES = "|".join(TITLES.values())
TITLE = rf"(?=[FHMSгκ])(?<!\p{{L}})(?:{ALL_TITLES})\.? "
#: Fixed given names by script and gender, surnames' stems, and their endings by gender.
GIVEN = {
    "latin": {"m": "Adam Albert Bruno Carl Daniel Felix Henri Hugo Jonas Julian Karl Leo Lucas Marco Martin Oscar Paul Peter Simon Thomas Victor Walter".split(), "f": "Alice Anna Camille Clara Elena Emma Eva Greta Helen Irene Julia Laura Lena Lucia Maria Martha Nora Olivia Paula Rosa Sara Vera".split()},
    "cyrillic": {"m": "Андрей Антон Борис Виктор Иван Максим Олег Павел Пётр Сергей".split(), "f": "Алла Анна Вера Елена Ирина Мария Нина Ольга Софья Татьяна".split()},
    "greek": {"m": "Ανδρέας Γιώργος Δημήτρης Κώστας Μάρκος Νίκος Πέτρος Στέφανος".split(), "f": "Άννα Ειρήνη Ελένη Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split()},
}
STEMS = {"latin": "Ald Arn Bell Berg Brad Cald Dal Ell Fair Gar Hal Hart Holl Kirk Lang Mar Nor Ost Pres Rad Sal Stan Thorn Wald West Win".split(), "cyrillic": "Андре Белов Волк Горд Жук Климов Лебед Миха Орл Петр Сокол Титов".split(), "greek": "Αγγελ Γεωργ Δημητρ Ιωανν Κωνσταντ Νικολ Παπαδ Στεφαν".split()}
ENDINGS = {"latin": {g: "ard bach berg by dale er ford hof ley man mond ner sen son stein ston ton well wick worth".split() for g in "mf"}, "cyrillic": {"m": "ин ов ский ынов".split(), "f": "ина ова ская ынова".split()}, "greek": {"m": "ίδης όπουλος άκης άτος".split(), "f": "ίδου οπούλου άκη άτου".split()}}
KNOWN = "|".join(n for script in GIVEN.values() for names in script.values() for n in names)
SURNAME = r"\p{Lu}[\p{Ll}'’-]++"
PERSON = rf"{TITLE}{SURNAME}(?: {SURNAME}){{0,2}}|(?=\p{{Lu}})(?<!\p{{L}})(?:{KNOWN})(?: {SURNAME}){{1,2}}"
TYPES = {"email": EMAIL, "ip": IP, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: What every entity has, and few texts have: tested first, as it is cheap.
SIGN = rf"[0-9@]|{TITLE}|(?=\p{{Lu}})(?<!\p{{L}})(?:{KNOWN}) \p{{Lu}}"

#: Letters by script and sort; a letter becomes another of its row, so many places on as the key decides.
ROWS = ["bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιουω"]
PLAIN = ("áàâäãåéèêëíìîïóòôöõúùûüýÿñçßά έήίόύώё", "aaaaaaeeeeiiiiooooouuuuyyncsα εηιουωе")
#: Other scripts by the range of letters that stand for each other, all of them assigned: first letter and how many.
SCRIPTS = {
    "Han": (0x4E00, 20902), "Hangul": (0xAC00, 11172), "Arabic": (0x0628, 19), "Hebrew": (0x05D0, 27), "Devanagari": (0x0915, 37), "Bengali": (0x0995, 20), "Tamil": (0x0BAE, 12), "Thai": (0x0E01, 46),
    "Hiragana": (0x3041, 86), "Katakana": (0x30A1, 90), "Armenian": (0x0561, 38), "Georgian": (0x10D0, 33), "Ethiopic": (0x1208, 63),
}


def has_any(text: Column) -> Column:
    return F.coalesce(text.rlike(SIGN) & text.rlike(ANY), F.lit(False))


def type_of(found: Column) -> Column:
    whole = [(name, rf"^(?:{p})$") for name, p in TYPES.items() if name != "person"]
    kind = F.when(found.rlike(whole[0][1]), whole[0][0])
    for name, p in whole[1:]:
        kind = kind.when(found.rlike(p), name)
    return kind.otherwise("person")


def gender(found: Column) -> Column:
    """m or f, by the title, else by the given name."""
    starts = [(g, rf"^(?:{TITLES[g]})\.? ") for g in "mf"]
    starts += [(g, rf"^(?:{'|'.join(n for script in GIVEN.values() for n in script[g])}) ") for g in "mf"]
    told = F.when(found.rlike(starts[0][1]), starts[0][0])
    for g, start in starts[1:]:
        told = told.when(found.rlike(start), g)
    return told.otherwise("m")


def canonical(kind: Column, found: Column) -> Column:
    """What all spellings of an entity share; of a person the gender and the name, which a title doesn't change."""
    name = F.concat(gender(found), F.lit(":"), F.lower(F.regexp_replace(found, f"^{TITLE}", "")))
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(found, r"\D", "")).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).when(kind == "person", name).otherwise(F.lower(found))


# The expressions below are SQL text: built from columns they would take longer to put together than to run.


def letter(c: str, n: str) -> str:
    """Another letter of c's script and case, and of its sort where that is known, or a digit for another number."""
    low = f"translate(lower({c}), '{PLAIN[0]}', '{PLAIN[1]}')"
    new = f"CASE WHEN {low} = '' THEN ''" + "".join(f" WHEN contains('{row}', {low}) THEN substring('{row}', (instr('{row}', {low}) + {n} % {len(row) - 1}) % {len(row)} + 1, 1)" for row in ROWS)
    for script, (first, many) in SCRIPTS.items():
        # As many places on as the key decides, but not all round; a letter outside the range takes any of it.
        place = f"if(ascii({low}) BETWEEN {first} AND {first + many - 1}, (ascii({low}) - {first} + 1 + {n} % {many - 1}) % {many}, {n} % {many})"
        new += f" WHEN rlike({low}, r'\\p{{Is{script}}}') THEN decode(unhex(lpad(hex({first} + {place}), 4, '0')), 'UTF-16BE')"
    for script, row in (("Cyrillic", ROWS[2]), ("Greek", ROWS[4])):
        new += f" WHEN rlike({low}, r'\\p{{Is{script}}}') THEN substring('{row}', {n} % {len(row)} + 1, 1)"
    new += f" WHEN rlike({low}, r'\\p{{N}}') THEN cast({n} % 10 as string) ELSE substring('{ROWS[0]}', {n} % {len(ROWS[0])} + 1, 1) END"
    return f"if({c} = lower({c}), {new}, upper({new}))"


def quoted(key: str) -> str:
    return key.replace("\\", "\\\\").replace("'", "\\'")


def stream(kind: str, form: str, key: str) -> str:
    """Keyed hexadecimal digits, four for each of 32 letters, and as many more as a long entity needs."""
    return f"array_join(transform(sequence(0, shiftright(length({form}), 5)), b -> sha2(concat_ws('\\u0001', '{quoted(key)}', {kind}, {form}, cast(tries as string), cast(b as string)), 512)), '')"


def blocks(part: str, key: str, of: str) -> str:
    """The same for a part of a long entity, as an array with the digits of 32 letters in each element; _whole is the digest
    of the entity's form."""
    return f"transform(sequence(0, shiftright(length({part}), 5)), b -> sha2(concat_ws('\\u0001', '{quoted(key)}', '{of}', _whole, cast(tries as string), cast(b as string)), 512))"


def replaced_by_place(shape: str, digits: str) -> str:
    """shape with its letters and digits replaced, each by the four digits of its place in blocks()."""
    n = f"cast(conv(substring(element_at({digits}, cast(shiftright(i, 5) as int) + 1), (i % 32) * 4 + 1, 4), 16, 10) as int)"
    new = f"CASE WHEN NOT rlike(c, r'[\\p{{L}}\\p{{N}}]') THEN c WHEN c BETWEEN '0' AND '9' THEN cast((cast(c as int) + 1 + {n} % 9) % 10 as string) ELSE {letter('c', n)} END"
    return f"if({shape} = '', '', array_join(transform(split({shape}, ''), (c, i) -> {new}), ''))"


def replaced(shape: str, digits: str, keep_first: str = "0", keep_last: str = "0") -> str:
    """shape with its letters and digits replaced, the j-th by the j-th four digits, all but so many at its ends."""
    plain, n = r"rlike(c, r'[\p{L}\p{N}]')", f"cast(conv(substring({digits}, a.j * 4 + 1, 4), 16, 10) as int)"
    new = f"CASE WHEN a.j < {keep_first} OR a.j >= size(filter(split({shape}, ''), c -> {plain})) - {keep_last} THEN c WHEN c BETWEEN '0' AND '9' THEN cast((cast(c as int) + 1 + {n} % 9) % 10 as string) ELSE {letter('c', n)} END"
    step = f"if({plain}, named_struct('j', a.j + 1, 'out', concat(a.out, {new})), named_struct('j', a.j, 'out', concat(a.out, c)))"
    return f"if({shape} = '', '', aggregate(split({shape}, ''), named_struct('j', 0, 'out', ''), (a, c) -> {step}, a -> a.out))"


def luhn_sum(digits: str) -> str:
    """The weighted digit sum of the check-digit rule; the last digit has weight one."""
    each = f"transform(split({digits}, ''), (d, i) -> coalesce(try_cast(d as int), 0) * if((length({digits}) - i) % 2 = 0, 2, 1) - if((length({digits}) - i) % 2 = 0 AND d > '4', 9, 0))"
    return f"aggregate({each}, 0, (a, x) -> a + x)"


def remainder(account: str) -> str:
    """An account number's remainder by 97, its first four characters taken last and letters as 10 to 35; 1 is valid."""
    turned = f"concat(substring({account}, 5), substring({account}, 1, 4))"
    return f"aggregate(split({turned}, ''), 0, (r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (r * 10 + cast(c as int)) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END)"


def pick(options: list[str], digits: str) -> str:
    """One of some names, by four of the keyed digits."""
    listed = ", ".join("'" + x + "'" for x in options)
    return f"element_at(array({listed}), cast(conv({digits}, 16, 10) as int) % {len(options)} + 1)"


def name_word(word: str, last: str, digits: str) -> str:
    """A name for a word of a name: a surname for the last one, a given name for those before, by script and gender."""
    made = "CASE"
    for script, sign in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        for g in "mf":
            surname = f"concat({pick(STEMS[script], f'substring({digits}, 1, 4)')}, {pick(ENDINGS[script][g], f'substring({digits}, 5, 4)')})"
            test = f"rlike({word}, r'{sign}') AND " if sign else ""
            made += f" WHEN {test}_gender = '{g}' THEN if({last}, {surname}, {pick(GIVEN[script][g], f'substring({digits}, 9, 4)')})"
    return made + " END"


def with_surrogates(e: DataFrame, key: str) -> DataFrame:
    """Rows kind, form, found, tries with their surrogate: column by column, so that each step is worked out once."""
    names = e.columns
    add = lambda d, **more: d.selectExpr("*", *(f"{sql} AS {c}" for c, sql in more.items()))
    e = add(
        e, _whole="sha2(form, 256)", _hex=stream("kind", "if(kind = 'email', sha2(form, 256), form)", key), _title=f"if(kind = 'person', regexp_extract(found, r'^({TITLE})', 1), '')", _domain="if(kind = 'email', substring_index(found, '@', -1), '')",
        _gender="if(kind = 'person', substring(form, 1, 1), '')",
        _shape="CASE WHEN kind IN ('email', 'ip', 'person') THEN '' ELSE found END",
        _local="if(kind = 'email', substring_index(found, '@', 1), '')",
        _first=r"CASE kind WHEN 'card' THEN 1 WHEN 'iban' THEN 2 WHEN 'phone' THEN length(regexp_extract(found, r'^\+(\d{1,3})(?=[ .-])', 1)) ELSE 0 END",
    )
    e = add(e, _new=replaced("_shape", "_hex", "_first"), _inner="substring(_domain, 1, length(_domain) - length(substring_index(_domain, '.', -2)))", _name=f"regexp_replace(found, r'^{TITLE}', '')")
    e = add(e, _digits=r"if(kind = 'card', regexp_replace(_new, r'\D', ''), '')", _form="if(kind = 'card', form, '')", _of_local=blocks("_local", key, "local"), _of_inner=blocks("_inner", key, "inner"))
    e = add(e, _rest=luhn_sum("concat(substring(_digits, 1, length(_digits) - 1), '0')") + " % 10", _good=luhn_sum("_form") + " % 10 = 0", _local_now=replaced_by_place("_local", "_of_local"), _inner_now=replaced_by_place("_inner", "_of_inner"))
    # Mail: inner labels of the domain are replaced, the label before the last becomes the reserved one.
    wide = f"translate(substring(_hex, 1, least(2 * (tries - {WIDER}) + 6, 60)), '0123456789abcdef', '{ROWS[0][:16]}')"
    label = f"if(tries >= {WIDER}, concat({wide}, '.'), '')"
    mail = f"concat(_local_now, '@', _inner_now, {label}, 'example.', substring_index(_domain, '.', -1))"
    # Network addresses: each number from 1 to 254.
    address = "concat_ws('.', " + ", ".join(f"cast(cast(conv(substring(_hex, {1 + 4 * k}, 4), 16, 10) as int) % 254 + 1 as string)" for k in range(4)) + ")"
    # Cards: the last digit satisfies the check if the original's did.
    card = "if(_good, concat(substring(_new, 1, length(_new) - 1), cast((10 - _rest) % 10 as string)), _new)"
    # Account numbers: the two digits after the country satisfy the check if the original's did.
    plain = "replace(_new, ' ', '')"
    checked = f"concat(substring(_new, 1, 2), lpad(cast(98 - {remainder(f'concat(substring({plain}, 1, 2), {chr(39)}00{chr(39)}, substring({plain}, 5))')} as string), 2, '0'), substring(_new, 5))"
    iban = f"if({remainder('form')} = 1, {checked}, _new)"
    # Names: each word by itself, so that a surname alone is still the same; of several words only the first tries again.
    words = f"array_join(transform(transform(split(_name, ' '), (w, i) -> named_struct('w', w, 'last', i = size(split(_name, ' ')) - 1, 'h', sha2(concat_ws('\\u0001', '{quoted(key)}', kind, lower(w), if(i = 0, cast(tries as string), '0')), 256))), x -> {name_word('x.w', 'x.last', 'x.h')}), ' ')"
    letters = f"CASE WHEN rlike(_name, r'\\p{{IsCyrillic}}') THEN '{ROWS[2][:16]}' WHEN rlike(_name, r'\\p{{IsGreek}}') THEN '{ROWS[4][:16]}' ELSE '{ROWS[0][:16]}' END"
    more = f"if(tries >= {WIDER}, concat('-', initcap(translate({wide}, '{ROWS[0][:16]}', {letters}))), '')"
    new = f"CASE kind WHEN 'email' THEN {mail} WHEN 'ip' THEN {address} WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'person' THEN concat(_title, {words}, {more}) ELSE _new END"
    return add(e, surrogate=new).select(*names, "surrogate")


def settled(occurrences: DataFrame, key: str) -> DataFrame:
    """kind, form, tries of every entity, as a written table: how often each had to try until no surrogate was taken. The
    tables of its rounds are deleted."""
    found = occurrences.groupBy("found").count().drop("count")  # copies meet before types are worked out
    typed = found.withColumn("kind", type_of(F.col("found"))).withColumn("form", canonical(F.col("kind"), F.col("found")))
    now = materialise(typed.groupBy("kind", "form").agg(F.min("found").alias("found")).withColumn("tries", F.lit(0)), "entities")
    real = now.select("kind", F.col("form").alias("new"))
    done: DataFrame | None = None
    tables = [now]
    for tried in range(LAST):
        # Written out before the joins: the optimizer would carry these long expressions through every constraint.
        made = materialise(with_surrogates(now, key).withColumn("new", canonical(F.col("kind"), F.col("surrogate"))), "made")
        # A surrogate goes to the first that has it, if it is nobody's real value and no earlier round gave it away.
        taken = real if done is None else real.unionByName(done.select("kind", "new"))
        first = made.join(taken, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min("form").alias("form"))
        first = materialise(first.withColumn("tries", F.lit(tried)), "settled")
        done = first if done is None else done.unionByName(first)
        now = materialise(now.join(first, ["kind", "form"], "left_anti").withColumn("tries", F.lit(tried + 1)), "again")
        tables += [made, first, now]
        if now.isEmpty():
            found = materialise(done.select("kind", "form", "tries"), "tries")
            for t in tables:
                forget(t)
            return found
    left = {r["kind"]: r["count"] for r in now.groupBy("kind").count().collect()}
    raise RuntimeError(f"no surrogates of their own after {LAST} tries: {left}")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and the column pii: kind, the surrogate put in, for each entity in order.
    Rows without an entity aren't shuffled. The others' entities are: distinct ones are worked out once, and go back to
    the rows by a join that is salted, as one entity may be in a third of all rows."""
    kept = [c for c in docs.columns if c not in (text, "pii")]
    columns = [F.col(f"`{c}`") for c in kept]
    has = has_any(F.col(text))
    pii = "array<struct<kind:string,surrogate:string>>"
    row, of, these = (free_name(docs, x) for x in ("row", "made", "these"))
    # Rows that are equal in all columns share a number, and what is worked out for it.
    hit = docs.where(has).withColumn(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c != "pii")))
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    occurrences = materialise(hit.select(F.col(row).alias("row"), F.explode(F.array_distinct(found)).alias("found")), "occurrences")
    each = occurrences.groupBy("found").count().drop("count").withColumn("kind", type_of(F.col("found"))).withColumn("form", canonical(F.col("kind"), F.col("found")))
    each, tries = materialise(each, "each"), settled(occurrences, key)
    made = materialise(with_surrogates(each.join(tries, ["kind", "form"]), key).select("found", "kind", "surrogate"), "made")
    forget(each)
    forget(tries)
    salted = made.select("found", F.struct("kind", "surrogate").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    back = occurrences.distinct().withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["found", "salt"])
    of_row = back.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("found", "s"))).alias(of)).withColumnRenamed("row", row)
    joined = hit.drop("pii").join(of_row, row).withColumn(these, F.transform(found, lambda f: F.element_at(of, f)).cast(pii))
    new = F.array_join(F.zip_with(F.split(text, ANY, -1), these, lambda gap, p: F.concat(gap, F.coalesce(p["surrogate"], F.lit("")))), "")
    return docs.where(~has).select(*columns, text, F.array().cast(pii).alias("pii")).unionByName(joined.select(*columns, new.alias(text), F.col(these).alias("pii")))
