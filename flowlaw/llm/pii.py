"""Operator 5, surrogates for personal data.

Entities are found by one pattern: mail addresses, telephone, account and card numbers, network addresses,
keys and passwords, and names behind a title. Each becomes one or two units (a name's given
and family part are units of their own, so that a family met again keeps its surrogate), and each
distinct unit gets a replacement from a keyed hash: digits for digits and letters for letters in
the same places, names of the same gender and script, private addresses for private ones.

Replacements are checked over the whole corpus: where two units would get the same one, or one that
occurs itself, all but one of them are drawn again. Only the distinct units take part in that. Names grow from draw to draw, so there are
always enough of them. A format of numbers or letters that has hardly more forms than the corpus has values is permuted at the end: all its values get
the images of a keyed one-to-one mapping of the format onto itself that leaves none in its place.

Every text is searched once. Only those with entities are cut at them, shuffled and put together again; the others go
straight through. A family name that was found in a text is replaced there where it stands alone, too.

All of it is DataFrame functions; no Python runs in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Titles by the gender that they tell, and those that tell none; between them and the name stands a space.
FEMALE = ("Mrs.", "Mrs", "MRS.", "Ms.", "Ms", "MS.", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra.", "Doña", "Signora", "г-жа", "Госпожа", "Κυρία")
MALE = ("Mr.", "Mr", "MR.", "Herr", "Monsieur", "Señor", "Sr.", "Don", "Signor", "г-н", "Господин", "Κύριος")
NEUTRAL = ("Dr.", "Dr", "DR.", "Prof.", "Professor", "Доктор", "Профессор")
#: Given names by gender and script.
GIVEN = {
    "f": {"latin": ("Ada", "Clara", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Sara", "Tessa", "Vera"), "cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга")},
    "m": {"latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Lukas", "Martin", "Oscar", "Paul", "Robert", "Simon"), "cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Олег", "Павел")},
}
#: Names are made of these, by script; the count of each list is a power of two.
SYLLABLES = {
    "latin": ("ba", "ber", "co", "dan", "del", "fer", "ga", "gor", "hal", "ke", "lan", "lor", "mar", "mi", "nel", "no", "pas", "per", "ri", "ros", "sal", "ser", "ta", "tor", "val", "ven", "wal", "wen", "yor", "zan", "zel", "vi"),
    "greek": ("βα", "γε", "δα", "ζη", "θα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τα", "φω", "χα", "λου"),
    "han": ("安", "白", "陈", "丁", "方", "高", "何", "江", "李", "林", "马", "宋", "唐", "文", "杨", "周"),
    "hangul": ("강", "권", "김", "남", "노", "류", "문", "박", "배", "서", "송", "안", "오", "윤", "정", "한"),
    "kana": ("ア", "イ", "エ", "カ", "キ", "サ", "シ", "タ", "ナ", "ノ", "ハ", "マ", "ミ", "ヤ", "ラ", "リ"),
    "arabic": ("با", "دا", "جا", "حا", "را", "زا", "سا", "شا", "طا", "عا", "فا", "قا", "كا", "لا", "ما", "نا"),
    "hebrew": ("בא", "גל", "דן", "הר", "זי", "חן", "טל", "יע", "כר", "לב", "מר", "נו", "סה", "עד", "פז", "רו"),
    "devanagari": ("आ", "क", "गा", "चा", "जा", "ता", "दे", "ना", "पा", "बा", "मा", "या", "रा", "ला", "वा", "सा"),
    "cyrillic": ("ба", "вер", "го", "дан", "жел", "зар", "ка", "лан", "мар", "ни", "пет", "рос", "сам", "тар", "фед", "чер"),
}
#: How a script's letters are found; those of any other script are replaced in Latin.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}", "kana": r"[\p{IsKatakana}\p{IsHiragana}]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}"}
TITLE = "|".join(x.replace(".", r"\.") for x in (*FEMALE, *MALE, *NEUTRAL))
#: The letters that titles begin with.
INITIALS = "".join(sorted({x[0] for x in (*FEMALE, *MALE, *NEUTRAL)}))
#: Names of secrets, with their value behind "=" or ":".
SECRETS = ("password", "passwd", "api_key", "secret", "token")
#: Alternatives in order; at one place the first that fits counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<=(?:{'|'.join(SECRETS)})[=:])[A-Za-z0-9]{{6,}}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])",
    "hexadecimal": r"(?<![A-Za-z0-9])(?=[0-9a-f]{32})(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+(?=(?:[ .()-]?[ .()-]?\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\.?\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d.])\d{3}\.\d{3}\.\d{4}(?![\d.])|(?<![\d-])0\d{2,4} \d{3,4} \d{3,4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{TITLE}) (?:\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?|[\p{{Lo}}\p{{M}}]+)",
}
PATTERN = rf"(?=[A-Za-z0-9(+{INITIALS}])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
#: Entities that numbers make hold one of these, which are found much faster.
HINT = r"[0-9][0-9. ()-]{5}|[0-9a-f]{32}|:[0-9a-f]{1,4}:|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
NAME_HINT = rf"(?=[{INITIALS}])(?<!\p{{L}})(?:{TITLE}) [\p{{Lu}}\p{{Lo}}]"
#: Tasks over which the texts with one value are dealt.
SALT = 16
#: Draws before a format is permuted, each of which leaves at most the share that its forms in use are of all of them; draws after which a name gets a syllable more.
ROUNDS, WIDER = 24, 4
#: Syllables of a name that is not drawn but must be one of its own.
LAST = 24


def _kind(entity: Column) -> Column:
    whole = lambda name: entity.rlike(rf"\A(?:{PATTERNS[name]})\z")
    return F.when(entity.contains("@"), "email").when(whole("ip"), "ip").when(whole("ipv6"), "ipv6").when(whole("name"), "name").when(whole("card"), "card").when(whole("iban"), "iban").when(whole("phone"), "phone").otherwise("secret")


def _units(entity: Column, before: Column) -> Column:
    """One or two structs of before (what stands unchanged in front), kind and value."""
    kind = _kind(entity)
    unit = lambda b, k, v: F.struct(b.alias("before"), k.alias("kind"), v.alias("value"))
    title = F.regexp_extract(entity, rf"\A(?:{TITLE}) ", 0)
    name = F.substr(entity, F.char_length(title) + 1)
    sex = F.when(F.trim(title).isin(*FEMALE), "f").when(F.trim(title).isin(*MALE), "m").otherwise("n")
    given = F.regexp_extract(name, r"\A(\S+) ", 1)
    family = F.regexp_extract(name, r"(\S+)\z", 1)
    ahead = F.concat(before, title)
    two = F.array(unit(ahead, F.concat(F.lit("given "), sex), given), unit(F.lit(" "), F.lit("family"), family))
    one = F.array(unit(ahead, F.lit("family"), family))
    return F.when((kind == "name") & (given != ""), two).when(kind == "name", one).otherwise(F.array(unit(before, kind, entity)))


def with_units(texts: DataFrame, text: str = "_text") -> DataFrame:
    """texts with _units, all units of a text in order, and _tail, what stands behind the last; both null if there are none.

    A unit's before also holds the text since the last one. The whole pattern runs only over texts with a hint.
    """
    whole = F.col(text)
    hinted = whole.contains("@") | whole.contains("AKIA") | whole.rlike(HINT) | whole.rlike(NAME_HINT)
    for name in SECRETS:
        hinted = hinted | whole.contains(name)
    found = texts.withColumn("_found", F.when(hinted, F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0))))
    found = found.withColumn("_plain", F.when(F.size("_found") > 0, F.split(whole, PATTERN, -1)))
    made = F.flatten(F.zip_with("_found", F.slice("_plain", F.lit(1), F.size("_found")), lambda e, b: _units(e, b)))
    return found.withColumn("_units", F.when(F.size("_found") > 0, made)).withColumn("_tail", F.when(F.size("_found") > 0, F.element_at("_plain", -1))).drop("_found", "_plain")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two units the same: case does not count in mail addresses and names, nor separators in numbers."""
    name = (kind == "family") | kind.startswith("given")
    return F.when((kind == "email") | name, F.lower(value)).when(kind.isin("card", "phone"), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def _digest(key: str, *parts: Column) -> Column:
    """Hexadecimal digits that nobody can foresee without the key."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 512)
    return F.concat(inner, F.sha2(F.concat(F.lit(key + "\x1e"), inner), 512))


def _number(hexes: Column, at: Column | int, digits: int = 6) -> Column:
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.substr(hexes, start, F.lit(digits)), 16, 10).cast("long")


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _shaped(value: Column, hexes: Column) -> Column:
    """value with each digit and Latin letter, in its case, replaced by a keyed one; anything else stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(hexes, F.pmod(i * 4, F.lit(250)))
        letter = lambda base: F.char(F.pmod(n, F.lit(26)) + base)
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _laid_out(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct((acc["k"] + F.when(digit, 1).otherwise(0)).alias("k"), F.concat(acc["s"], F.when(digit, F.substr(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(_chars(value), start, step, lambda acc: acc["s"])


def _syllables(hexes: Column, script: str, n: Column, at: Column) -> Column:
    """n syllables, from the keyed digits behind a place on; where those end they begin again."""
    parts = F.array(*map(F.lit, SYLLABLES[script]))
    one = lambda i: F.get(parts, F.pmod(_number(hexes, F.pmod(at + 6 * i, F.lit(250))), F.lit(len(SYLLABLES[script]))).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def _named(value: Column, hexes: Column, more: Column) -> Column:
    """A name in the script, the case and about the length of value; what stands between its letters stays. The first part has so many syllables more."""

    def part(run: Column, i: Column) -> Column:
        at, made = i * 37 + 8, F.lit(None).cast("string")
        short = F.greatest(F.lit(1), F.round(F.char_length(run) / 3).cast("int")) + F.when(i == 0, more).otherwise(0)
        single = F.greatest(F.lit(1), F.char_length(run)) + F.when(i == 0, more).otherwise(0)
        made = _syllables(hexes, "latin", short, at)
        for script, letters in SCRIPTS.items():
            made = F.when(run.rlike(letters), _syllables(hexes, script, single if script in ("han", "hangul") else short, at)).otherwise(made)
        made = F.when((run == F.upper(run)) & (run != F.lower(run)) & (F.char_length(run) > 1), F.upper(made)).when(run == F.initcap(run), F.initcap(made)).otherwise(made)
        return F.when(run.rlike(r"\p{L}"), made).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0)), part), "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a sound check digit."""
    return _luhn_rest(digits) == 0


def _luhn_rest(digits: Column) -> Column:
    """What the weighted sum of a string's digits leaves of tens."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.pmod(c.try_cast("int") * 2, F.lit(10)) + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(value: Column, hexes: Column) -> Column:
    """The first digit stays, and whether the check digit is sound."""
    digits = F.regexp_replace(value, r"\D", "")
    drawn = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.substr(_shaped(digits, hexes), F.lit(2)))
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.regexp_replace(drawn, r"\d\z", ""), d.cast("string")))
    return _laid_out(value, F.when(_luhn(digits), F.get(F.filter(ends, _luhn), F.lit(0))).otherwise(drawn))


def _phone(value: Column, hexes: Column) -> Column:
    """The country code stays."""
    digits = F.regexp_replace(value, r"\D", "")
    code = F.char_length(F.regexp_extract(value, r"\A\+(\d{1,3})(?=[ .(-])", 1))
    return _laid_out(value, F.concat(F.substr(digits, F.lit(1), code), F.substr(_shaped(digits, hexes), code + 1)))


def _email(value: Column, hexes: Column) -> Column:
    """The shape of the local part stays; the domain becomes one below example.org, which is reserved."""
    local = F.regexp_extract(value, r"\A([^@]*)@", 1)
    return F.concat(_shaped(local, hexes), F.lit(".x"), F.substr(hexes, F.lit(200), F.lit(6)), F.lit("@mail."), F.substr(hexes, F.lit(210), F.lit(4)), F.lit(".example.org"))


def _iban(value: Column, hexes: Column) -> Column:
    """The country, and all separators, stay."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return _separated(value, F.concat(F.substr(plain, F.lit(1), F.lit(2)), _shaped(F.substr(plain, F.lit(3)), hexes)))


def _separated(value: Column, plain: Column) -> Column:
    """plain with spaces where value has them."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))
    step = lambda acc, c: F.struct((acc["k"] + F.when(c == " ", 0).otherwise(1)).alias("k"), F.concat(acc["s"], F.when(c == " ", " ").otherwise(F.substr(plain, acc["k"] + 1, F.lit(1)))).alias("s"))
    return F.aggregate(_chars(value), start, step, lambda acc: acc["s"])


def _secret(value: Column, hexes: Column) -> Column:
    """Hexadecimal digits for such with letters among them, a known prefix before the rest of its shape, or the shape alone.

    Where a value is longer than the keyed digits are, they begin again.
    """
    enough = F.repeat(hexes, F.ceil(F.char_length(value) / F.char_length(hexes)).cast("int"))
    key = F.concat(F.lit("AKIA"), _shaped(F.substr(value, F.lit(5)), hexes))
    return F.when(value.rlike(r"\A(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]+\z"), F.substr(enough, F.lit(1), F.char_length(value))).when(value.startswith("AKIA"), key).otherwise(_shaped(value, hexes))


def _ip(value: Column, hexes: Column) -> Column:
    """Numbers from 1 to 254 behind what marks a private network, which stays; other addresses begin with 11 to 126."""
    part = lambda i, low=1, n=254: (F.pmod(_number(hexes, 10 * i), F.lit(n)) + low).cast("string")
    private = F.regexp_extract(value, r"\A(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    two, four = F.concat_ws(".", part(2), part(3)), F.concat_ws(".", part(0, 11, 116), part(1), part(2), part(3))
    return F.when(private == "", four).when(private.rlike(r"\A1\d+\.\z"), F.concat(private, part(1), F.lit("."), two)).otherwise(F.concat(private, two))


def _ipv6(hexes: Column) -> Column:
    """Eight groups, the first two those of the network that is reserved for examples."""
    return F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substr(hexes, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])


def surrogate(kind: Column, value: Column, hexes: Column, more: Column | None = None) -> Column:
    """The replacement that the keyed digits of hexes make of a value. more: syllables that names have besides those of their length."""
    more = F.lit(0) if more is None else more
    script = F.lit("latin")
    for name, letters in SCRIPTS.items():
        script = F.when(value.rlike(letters), name).otherwise(script)
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), F.pmod(_number(hexes, at), F.lit(len(names))).cast("int"))
    # A given name alone is no key to a person; a second one keeps different ones apart. Where scripts have no list, a made name does.
    given = _named(value, hexes, more + 2)
    for written in ("latin", "cyrillic"):
        for sex in ("f", "m", "n"):
            names = GIVEN[sex][written] if sex in GIVEN else (*GIVEN["f"][written], *GIVEN["m"][written])
            double = F.concat(pick(names, 0), F.lit("-"), F.initcap(_syllables(hexes, written, more + 3, F.lit(8))))
            given = F.when((kind == f"given {sex}") & (script == written), F.when((value == F.upper(value)) & (F.char_length(value) > 1), F.upper(double)).otherwise(double)).otherwise(given)
    return (
        F.when(kind == "email", _email(value, hexes))
        .when(kind == "ip", _ip(value, hexes))
        .when(kind == "ipv6", _ipv6(hexes))
        .when(kind == "iban", _iban(value, hexes))
        .when(kind == "card", _card(value, hexes))
        .when(kind == "phone", _phone(value, hexes))
        .when(kind == "secret", _secret(value, hexes))
        .when(kind == "family", _named(value, hexes, more + 1))
        .otherwise(given)
    )


def _kept(kind: Column, canon: Column) -> Column:
    """How many characters a permuted value keeps in front: what marks a network, a country or a card's issuer."""
    private = F.char_length(F.regexp_extract(canon, r"\A(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\d+\.\d+\.)", 1))
    domain = F.lit(0)
    return F.when(kind == "ip", private).when(kind == "iban", 2).when(kind.isin("card", "phone"), 1).when((kind == "secret") & canon.startswith("AKIA"), 4).otherwise(domain)


def _places(kind: Column, canon: Column) -> Column:
    """The parts of a value that are permuted one by one: numbers of an address, else characters."""
    rest = F.substr(canon, _kept(kind, canon) + 1)
    return F.when(kind == "ip", F.regexp_extract_all(rest, F.lit(r"\d+|\."), F.lit(0))).otherwise(_chars(rest))


def permuted(kind: Column, canon: Column, key: str) -> Column:
    """The image of a canonical value under a keyed one-to-one mapping of its format onto itself that leaves no value in its place.

    Each digit, letter or number of an address moves around its own range, by an amount that depends on the key and all before it; the first one, of which
    nothing comes before, by an amount of its format that is never 0. A card keeps its check digit sound or not. Characters of other kinds stay, as do those of a value that has no digit or Latin letter.
    """
    hexadecimal = canon.rlike(r"\A[0-9a-f]{32,}\z") | (kind == "ipv6")
    size = lambda c: F.when(kind == "ip", F.when(c == ".", 1).otherwise(256)).when(c.rlike("[0-9]"), 10).when(hexadecimal & c.rlike("[a-f]"), 6).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    kept = F.substr(canon, F.lit(1), _kept(kind, canon))
    start = F.struct(kept.alias("before"), F.lit(False).alias("moved"), kept.alias("s"))

    def step(acc: Column, c: Column) -> Column:
        n = size(c)
        drawn = _number(_digest(key, kind, F.lit("permuted"), acc["before"]), 0, 12)
        # The first place that moves does so by an amount that only what stands before it, which stays, decides.
        by = F.when(acc["moved"], F.pmod(drawn, n)).otherwise(1 + F.pmod(drawn, F.greatest(n - 1, F.lit(1))))
        number = F.when(kind == "ip", c.try_cast("long")).otherwise(F.ascii(c).cast("long") - base(c))
        put = F.pmod(number + by, n)
        new = F.when(n == 1, c).when(kind == "ip", put.cast("string")).otherwise(F.char(put + base(c)))
        return F.struct(F.concat(acc["before"], F.when(n == 1, c).otherwise(F.concat(c, F.lit("|")))).alias("before"), (acc["moved"] | (n > 1)).alias("moved"), F.concat(acc["s"], new).alias("s"))

    free = F.when(kind == "card", F.slice(_places(kind, canon), F.lit(1), F.greatest(F.size(_places(kind, canon)) - 1, F.lit(0)))).otherwise(_places(kind, canon))
    out = F.aggregate(free, start, step, lambda acc: acc["s"])
    ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(out, d.cast("string")))
    card = F.get(F.filter(ends, lambda x: _luhn_rest(x) == _luhn_rest(canon)), F.lit(0))
    return F.when(kind == "card", card).otherwise(out)


def _last(left: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """kind, value, replacement of what draws have left, and of all values of the formats of such: names of very many syllables, other values permuted.

    A permuted value may be a value of the corpus, which has another one itself. Formats are told apart by kind and by what permuting keeps.
    """
    named = (F.col("kind") == "family") | F.col("kind").startswith("given")
    shape = F.when(F.col("kind") == "ip", F.regexp_replace(F.substr("canon", _kept(F.col("kind"), F.col("canon")) + 1), r"\d+", "0")).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace("canon", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"))
    format_ = F.concat_ws("\x1f", "kind", shape, F.substr("canon", F.lit(1), _kept(F.col("kind"), F.col("canon"))))
    hexes = _digest(key, F.col("kind"), F.col("canon"), F.lit("last"))
    one = surrogate(F.col("kind"), F.col("value"), hexes, F.lit(LAST))
    names = left.filter(named).select("kind", "value", one.alias("replacement"))
    other = left.filter(~named).select("kind", "value", "canon")
    full = other.select(format_.alias("_format")).distinct()
    rest = None
    if done is not None:
        marked = done.withColumn("_format", format_)
        other = other.unionByName(marked.filter(~named).join(full, "_format", "left_semi").select("kind", "value", "canon"))
        rest = marked.join(full, "_format", "left_anti").select("kind", "value", "replacement")
    image = permuted(F.col("kind"), F.col("canon"), key)
    laid = F.when(F.col("kind").isin("card", "phone"), _laid_out(F.col("value"), F.col("_image"))).when(F.col("kind") == "iban", _separated(F.col("value"), F.col("_image"))).otherwise(F.col("_image"))
    moved = other.withColumn("_image", image).select("kind", "value", laid.alias("replacement"))
    out = names.unionByName(moved)
    return out if rest is None else out.unionByName(rest)


def surrogates(values: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, value and replacement for the distinct kind and value.

    Values with the same canonical form are written alike but for their separators and case. Two different
    canonical forms of a kind never share a replacement, and no replacement is a value of the corpus: those
    that clash are drawn again, all but the first, until none do. What still clashes after that many rounds, as a
    format may have hardly more forms than the corpus has values, is permuted within its format, together with all of that format (see permuted()); only
    then a replacement may be another value of the corpus, but never the value itself. No values: no rows.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = canonical(F.col("kind"), F.col("value"))
    # Dealt by a hash into tasks of its own number, as a draw is costly and the rows are small.
    left = cut(values.select("kind", "value").distinct().withColumn("canon", mark).repartition(tasks, "kind", "canon"))
    own = left.select("kind", F.col("canon").alias("taken")).distinct()
    done: DataFrame | None = None
    for attempt in range(rounds):
        drawn = left.withColumn("hexes", _digest(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
        drawn = drawn.withColumn("replacement", surrogate(F.col("kind"), F.col("value"), F.col("hexes"), F.lit(attempt // WIDER)))
        drawn = cut(drawn.drop("hexes").withColumn("taken", canonical(F.col("kind"), F.col("replacement"))))
        first = Window.partitionBy("kind", "taken").orderBy("canon")
        # A replacement is asked for by a few values at most, so these windows stay small.
        claims = drawn.select("kind", "canon", "taken").distinct()
        if done is not None:
            claims = claims.join(done.select("kind", "taken").distinct(), ["kind", "taken"], "left_anti")
        won = claims.join(own, ["kind", "taken"], "left_anti").withColumn("n", F.row_number().over(first)).filter("n = 1").select("kind", "canon")
        good = drawn.join(won, ["kind", "canon"])
        left = cut(drawn.join(won, ["kind", "canon"], "left_anti").select("kind", "value", "canon"))
        done = good if done is None else done.unionByName(good)
        if left.isEmpty():
            return done.select("kind", "value", "replacement")
        done = cut(done)
    return _last(left, done, key)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text's personal data replaced; the added column pii_units counts the units.

    docs: text and any other columns; one named pii_units is replaced. Null texts stay null and have
    no units, empty ones stay empty. Texts of any length are searched whole. Rows are told apart by their text alone, so repeated
    rows, null ids and ties agree. No rows: no rows.
    """
    keep = [c for c in docs.columns if c not in ("text", "pii_units")]
    pad = next(f"_{n}" for n in range(len(keep) + 1) if f"_{n}" not in keep)  # a struct needs a field
    texts = docs.select(F.struct(*keep, F.lit(0).alias(pad)).alias("_row"), F.col("text").alias("_text"))
    found = with_units(texts)
    # A text's mark: its length and two hashes. The text itself is kept only where nothing was found in it.
    hit = F.col("_units").isNotNull()
    mark = F.concat_ws("-", F.xxhash64("_text"), F.hash("_text"), F.char_length("_text"))
    searched = cut(found.select("_row", F.when(~hit, F.col("_text")).alias("_text"), "_units", "_tail", hit.alias("_hit"), F.when(hit, mark).alias("_mark")))
    plain = searched.filter(~F.col("_hit")).select("_row.*", F.col("_text").alias("text"), F.lit(0).alias("pii_units"))
    cut_up = searched.filter("_hit")
    units = cut_up.select("_mark", F.posexplode("_units").alias("at", "unit"))
    units = cut(units.select("_mark", "at", "unit.kind", "unit.value").distinct())
    # A value may stand in a third of all texts: its rows are dealt to SALT tasks, and each replacement to all of these.
    salt = F.pmod(F.xxhash64("_mark"), F.lit(SALT)).cast("int")
    new = surrogates(units, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    lists = units.withColumn("_salt", salt).join(new, ["kind", "value", "_salt"]).groupBy("_mark").agg(F.sort_array(F.collect_list(F.struct("at", "replacement"))).alias("_new"))
    lists = cut(lists)  # so that the join deals out both sides anew, and the texts of a mark that many rows have can be split
    joined = cut_up.join(lists.hint("merge"), "_mark")  # the same way at every size
    both = F.zip_with("_units", "_new", lambda u, n: F.struct(u["before"].alias("before"), u["kind"].alias("kind"), u["value"].alias("value"), n["replacement"].alias("replacement")))
    named = joined.withColumn("_both", both).withColumn("_families", F.array_distinct(F.transform(F.filter("_both", lambda u: (u["kind"] == "family") & (F.char_length(u["value"]) > 2)), lambda u: F.struct(u["value"].alias("value"), u["replacement"].alias("replacement")))))
    text = F.concat(F.array_join(F.transform("_both", lambda u: F.concat(_renamed(u["before"]), u["replacement"])), ""), _renamed(F.col("_tail")))
    changed = named.select("_row.*", text.alias("text"), F.size("_units").cast("int").alias("pii_units"))
    out = plain.drop(pad).unionByName(changed.drop(pad))
    return out.select(*[c for c in docs.columns if c != "pii_units"], "pii_units")


def _renamed(piece: Column) -> Column:
    """A piece between units with the families of its text replaced where they stand alone."""
    name = lambda x: F.concat(F.lit(r"(?<!\p{L})\Q"), x["value"], F.lit(r"\E(?!\p{L})"))
    return F.aggregate("_families", piece, lambda text, x: F.when(text.contains(x["value"]), F.regexp_replace(text, name(x), x["replacement"])).otherwise(text))
