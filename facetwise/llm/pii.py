"""Format-preserving pseudonyms for personal data, with DataFrame and SQL functions only.

Values are found by one alternation of patterns, validated, and mapped by a keyed Feistel permutation of their own
domain, so that equal values stay equal across documents and different values stay different:

  card numbers (13 to 19 digits, Luhn valid)    all digits but the last are permuted, the check digit is made anew
  other numbers of 13 to 19 digits              the leading digits and the distance of the last one from the check digit
                                                are permuted, so the result has no valid check digit either
  numbers of 20 and more digits                 pieces of up to 18 digits are permuted, each with the piece before as key
  social security numbers                       permuted among the valid ones (898 areas, 99 groups, 9999 serials)
  telephone numbers                             the last ten digits are permuted; prefix and punctuation stay
  IPv4 addresses                                permuted among all addresses
  dates, years 1800 to 2199                     permuted among the 146,097 days of these 400 years, format kept; those
                                                that can only be read month first among the 88,497 days of that kind
  e-mail addresses, keys and tokens             a keyed digest in the shape of the local part or of the token

Invalid candidates (an octet of 300, the 31st of February) stay as they are. A permutation of Z_a x Z_b alternates
l += f(r) mod a and r += f(l) mod b, f being a keyed SHA-256 digest: a bijection for any a and b. Whoever has the key can
undo the permutations, so it is a required argument and must be kept secret.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 5

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OTHER = r"\s@<>()\[\],;:\"'|"
_ASSIGNED = r"(?i:token|secret|passw|pwd|key)\w{0,6} {0,2}[=:] {0,2}[\"']"
#: What may follow an edge and a digit, by kind, in order of precedence. A date may be followed by a time.
_DIGITS = {
    "date": rf"(?:[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}})(?:{_END}|(?=T[0-9]))",
    "ssn": rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "ip": rf"(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?!\.?[0-9]){_END}",
    "phone": rf"[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_END}",
    "number": rf"(?:(?:[0-9]{{4}}[ -]){{3}}[0-9]{{1,7}}|[0-9]{{13,}}+){_END}",
}
#: Kinds by pattern, without capturing groups; of two that match at a place the earlier one counts.
PATTERNS = {
    "email": rf"(?<![^{_OTHER}])[^{_OTHER}]++@[^{_OTHER}.]++(?:\.[^\W_]++)+",
    "secret": rf"{_ASSIGNED}[^\s\"']{{8,}}+(?=[\"'])"
    rf"|(?=[0-9a-fA-Fgs]){_EDGE}(?:(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{{32,}}+|AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36}}|sk-[0-9A-Za-z]{{20,}}+){_END}",
    **{k: rf"(?=[0-9]){_EDGE}{p}" for k, p in _DIGITS.items()},
}
PATTERNS["phone"] += rf"|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_END}|\+[0-9]{{11,14}}{_END}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}{_END}"
ANY = "|".join(
    [PATTERNS["email"], PATTERNS["secret"], PATTERNS["phone"].split("|", 1)[1], rf"(?=[0-9]){_EDGE}(?:{'|'.join(_DIGITS.values())})"]
)
#: No pattern matches a text without one of these.
SIGN = r"[0-9@]|[\"'][^\s\"']{8}|AKIA|gh[pousr]_|sk-|[a-fA-F]{32}"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permuted(a: str, b: str, left: str, right: str, key: str) -> str:
    """SQL for the image (l, r) of (left, right) in Z_a x Z_b; key is SQL too."""
    f = f"cast(conv(substr(sha2(concat({key}, '/', i, '/', {{}}, '/', {{}}), 256), 1, 15), 16, 10) as bigint)"
    l_new = f"pmod(s.l + {f.format(repr('l'), 's.r')}, {a})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)),"
        f" (s, i) -> transform(array({l_new}), l -> named_struct('l', l, 'r', pmod(s.r + {f.format(repr('r'), 'l')}, {b})))[0])"
    )


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced by `digits`, in order."""
    return (
        f"aggregate(sequence(1, length({shape})), named_struct('o', '', 'k', 1), (z, j) ->"
        f" if(substr({shape}, j, 1) between '0' and '9',"
        f" named_struct('o', concat(z.o, substr({digits}, z.k, 1)), 'k', z.k + 1),"
        f" named_struct('o', concat(z.o, substr({shape}, j, 1)), 'k', z.k))).o"
    )


def _permuted_digits(d: str, key: str) -> str:
    """Digits d (2 to 18) permuted among strings of their length."""
    half = f"div(length({d}), 2)".replace("div(", "cast(floor(").replace(", 2)", " / 2) as int)")
    a, b = f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, length({d}) - {half}) as bigint)"
    image = _permuted(a, b, f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", key)
    return _let("p", image, f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), length({d}) - {half}, '0'))")


def _luhn(d: str, doubled_from: int) -> str:
    """Luhn sum; the digits at even (0) or odd (1) distance from the right end, plus one, are doubled."""
    digit = f"cast(substr({d}, length({d}) - n, 1) as int)"
    twice = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, n) -> t + if(n % 2 = {doubled_from}, {twice}, {digit}))"


def _check(q: str) -> str:
    """SQL for the check digit of the digits q."""
    return f"(10 - {_luhn(q, 0)} % 10) % 10"


def _invalid(d: str, key: str) -> str:
    """Digits d (13 to 19) with a wrong check digit permuted among such strings of their length."""
    half, rest = f"cast(floor((length({d}) - 1) / 2) as int)", f"(length({d}) - 1 - cast(floor((length({d}) - 1) / 2) as int))"
    off = f"(pmod(cast(right({d}, 1) as int) - {_check(f'left({d}, length({d}) - 1)')}, 10) - 1)"
    image = _permuted(f"cast(pow(10, {half}) as bigint)", f"9 * cast(pow(10, {rest}) as bigint)", f"substr({d}, 1, {half})", f"9 * cast(substr({d}, {half} + 1, {rest}) as bigint) + {off}", key)
    lead = f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r div 9 as string), {rest}, '0'))"
    return _let("p", image, _let("q", lead, f"concat(q, cast(({_check('q')} + 1 + p.r % 9) % 10 as string))"))


def _long(d: str, key: str) -> str:
    """Digits d (20 and more) permuted piece by piece."""
    n = f"cast(ceil(length({d}) / 18) as int)"
    cut = f"substr({d}, cast(w * length({d}) div n as int) + 1, cast((w + 1) * length({d}) div n as int) - cast(w * length({d}) div n as int))"
    piece = _let("c", cut, _permuted_digits("c", f"concat({_lit(key)}, '/', n, '/', w, '/', z.was)"))
    step = _let("g", piece, "named_struct('o', concat(z.o, g), 'was', g)")
    return _let("n", n, f"aggregate(sequence(0, n - 1), named_struct('o', '', 'was', ''), (z, w) -> {step}).o")


def _number(x: str, key: str) -> str:
    card = _let("q", _permuted_digits("substr(d, 1, length(d) - 1)", _lit(key + "/card")), f"concat(q, cast({_check('q')} as string))")
    image = f"if(length(d) > 19, {_long('d', key + '/long')}, if({_luhn('d', 1)} % 10 = 0, {card}, {_invalid('d', _lit(key + '/number'))}))"
    return _let("d", _digits(x), f"if(length(d) >= 13, {_let('e', image, _refill(x, 'e'))}, {x})")


def _phone(x: str, key: str) -> str:
    image = f"concat(substr(d, 1, length(d) - 10), {_permuted_digits('right(d, 10)', _lit(key + '/phone'))})"
    return _let("d", _digits(x), f"if(length(d) >= 10, {_let('g', image, _refill(x, 'g'))}, {x})")


def _ssn(x: str, key: str) -> str:
    area, group, serial = (f"cast(substr({x}, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    left = f"(({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1)"
    image = _permuted("88902", "9999", left, f"{serial} - 1", _lit(key + "/ssn"))
    place = "cast(floor(p.l / 99) as int)"
    text = f"concat_ws('-', lpad(cast({place} + if({place} >= 665, 2, 1) as string), 3, '0'), lpad(cast(p.l % 99 + 1 as string), 2, '0'), lpad(cast(p.r + 1 as string), 4, '0'))"
    return f"if({valid}, {_let('p', image, text)}, {x})"


def _ip(x: str, key: str) -> str:
    octet = "cast(o[{}] as int)".format
    image = _permuted("65536", "65536", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", _lit(key + "/ip"))
    parts = ", ".join(f"cast({y} as int)" for y in ("floor(p.l / 256)", "p.l % 256", "floor(p.r / 256)", "p.r % 256"))
    return _let("o", f"split({x}, '[.]')", f"if(forall(o, y -> cast(y as int) < 256), {_let('p', image, f'concat_ws(chr(46), {parts})')}, {x})")


def _month_first(t: str, key: str) -> str:
    """Date t, with a day over 12, permuted among such days of the 400 years."""
    months = f"((year({t}) - 1800) * 12 + month({t}) - 1)"
    start = "datediff(add_months(date'1800-01-01', {0}), date'1800-01-01') - 12 * {0}".format
    image = _permuted("9", "9833", f"(datediff({t}, date'1800-01-01') - 12 * ({months} + 1)) div 9833", f"(datediff({t}, date'1800-01-01') - 12 * ({months} + 1)) % 9833", _lit(key + "/month"))
    guess = "cast(e * 4800 div 88497 as int)"  # the month is at most two off
    month = f"array_max(filter(sequence(greatest({guess} - 2, 0), least({guess} + 2, 4799)), k -> {start('k')} <= e))"
    day = f"date_add(add_months(date'1800-01-01', k), cast(12 + e - ({start('k')}) as int))"
    return _let("p", image, _let("e", "(p.l * 9833 + p.r)", _let("k", month, day)))


def _date(x: str, key: str) -> str:
    first = f"{x} rlike '^[0-9]{{4}}'"
    sep = f"if({first}, substr({x}, 5, 1), substr({x}, 3, 1))"
    d = f"regexp_replace({x}, '[^0-9]', '')"
    shapes = (  # the day comes first if it can
        f"if({first}, 'yyyyMMdd', if(try_to_date(d, 'ddMMyyyy') is null, 'MMddyyyy', 'ddMMyyyy'))"
    )
    days = "datediff(t, date'1800-01-01')"
    image = _permuted("189", "773", f"floor({days} / 773)", f"{days} % 773", _lit(key + "/date"))
    moved = _let("p", image, "date_add(date'1800-01-01', cast(p.l * 773 + p.r as int))")
    moved = f"if(f = 'MMddyyyy', {_month_first('t', key)}, {moved})"
    y, m, dd = "date_format(w, 'yyyy')", "date_format(w, 'MM')", "date_format(w, 'dd')"
    text = f"concat_ws({sep}, case f when 'yyyyMMdd' then {y} when 'MMddyyyy' then {m} else {dd} end, case f when 'MMddyyyy' then {dd} else {m} end, if(f = 'yyyyMMdd', {dd}, {y}))"
    inner = f"if(t between date'1800-01-01' and date'2199-12-31', {_let('w', moved, text)}, {x})"
    typed = "case f when 'yyyyMMdd' then try_to_date(d, 'yyyyMMdd') when 'MMddyyyy' then try_to_date(d, 'MMddyyyy') else try_to_date(d, 'ddMMyyyy') end"
    return _let("d", d, _let("f", shapes, _let("t", typed, f"coalesce({inner}, {x})")))


def _email(x: str, key: str) -> str:
    return f"concat('u', substr(sha2(concat({_lit(key)}, '/email/', lower({x})), 256), 1, 15), '@', substring_index({x}, '@', -1))"


def _secret(x: str, key: str) -> str:
    """The digest of what follows a name and a quote, or of the whole, repeated to its length."""
    name = f"regexp_extract({x}, {_lit('^' + _ASSIGNED)}, 0)"
    digest = f"sha2(concat({_lit(key)}, '/secret/', y), 512)"
    text = f"substr(repeat({digest}, cast(length(y) div 128 as int) + 1), 1, length(y))"
    image = f"if(y = upper(y), upper({text}), {text})"
    return _let("a", name, _let("y", f"substr({x}, length(a) + 1)", f"concat(a, {image})"))


#: (kind, anchored pattern, replacement)
_KINDS = {"email": _email, "secret": _secret, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "number": _number}


def _kind(x: str) -> str:
    """SQL for the kind of a match."""
    return "case " + " ".join(f"when {x} rlike {_lit('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items() if k != "secret") + " else 'secret' end"


def _free(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pseudonymize(docs: DataFrame, *, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """docs with `text` pseudonymised and a column `found` of structs (kind, value), value being the pseudonym in place.

    Null texts stay null with no findings; empty texts and texts without findings stay as they are; texts of any length
    are searched whole. The result of a value depends on the value and the key alone, so repeated rows stay repeated. An
    empty table gives no rows. A column named like `found` is replaced; all other columns stay, whatever their names.
    """
    t = f"`{text}`"
    image = "case k " + " ".join(f"when '{k}' then {f('x', key)}" for k, f in _KINDS.items()) + " end"
    hits = f"if({t} rlike {_lit(SIGN)}, regexp_extract_all({t}, {_lit(ANY)}, 0), array())"
    mapped = _let("k", _kind("x"), f"named_struct('kind', k, 'value', {image})")
    hit, made = _free([*docs.columns, text, found], "found_values"), _free([*docs.columns, text, found], "made_values")
    out = docs.withColumn(hit, F.expr(hits))
    out = out.withColumn(made, F.expr(f"if(size({hit}) > 0, transform({hit}, x -> {mapped}), array())"))
    parts = f"split({t}, {_lit(ANY)}, -1)"
    joined = f"array_join(flatten(zip_with({parts}, {made}, (a, m) -> array(a, coalesce(m.value, '')))), '')"
    out = out.withColumn(text, F.expr(f"if(size({hit}) > 0, {joined}, {t})"))
    return out.withColumn(found, F.expr(f"coalesce({made}, array())")).drop(hit, made)
