"""SQL for DuckDB that gives the rows of the detectors. Its patterns know no lookaround, so the text gets marks first: where a run of digits begins and ends, where an abbreviated period stands, where an address may end."""

from __future__ import annotations

from tracefold.operators import detect
from tracefold.operators.profile import Profile, alternation

#: Marks: none of them stands in a text.
BEGIN, END, SHORT, STOP, COLON = "\x01", "\x02", "\x03", "\x04", "\x05"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _unmarked(x: str) -> str:
    return f"replace(regexp_replace({x}, '[\x01\x02\x04\x05]', '', 'g'), '\x03', '.')"


def found(name: str, source: str, pattern: str, group: int, marked: str = "text") -> str:
    """CTEs ending in ``name``: doc_id, text, raw (whole match), value (the group), s (start of the group 1 or of the match), e (end of the match) of every match over the ``marked`` text of ``source``."""
    p = _quoted(pattern)
    return f"""
{name}_m AS (SELECT doc_id, text, {marked} AS t FROM {source} WHERE text IS NOT NULL),
{name}_p AS (SELECT doc_id, text, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, 1) AS core, regexp_extract_all(t, {p}, {group}) AS val FROM {name}_m),
{name}_r AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM {name}_p),
{name}_o AS (SELECT doc_id, text, {_unmarked('core[i]')} AS raw, {_unmarked('val[i]')} AS value, length({_unmarked("array_to_string(gaps[1:i], '') || array_to_string(whole[1:i - 1], '')")}) + position(core[i] IN whole[i]) - 1 - length(left(whole[i], position(core[i] IN whole[i]) - 1)) + length({_unmarked("left(whole[i], position(core[i] IN whole[i]) - 1)")}) AS s FROM {name}_r),
{name} AS (SELECT *, s + length(raw) AS e FROM {name}_o)"""


def passage(s: str = "s", e: str = "e") -> str:
    return f"replace(regexp_replace(substring(text, greatest(0, {s} - 60) + 1, {e} + 60 - greatest(0, {s} - 60)), '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"


def before(n: int) -> str:
    return f"substring(text, greatest(0, s - {n}) + 1, s - greatest(0, s - {n}))"


_DIGITS = "regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
PHONE = "(?:^|[^\x02])((?:\\+?\x011\x02?[-.\\s]?\\(?\x01?|\\(?\x01)\\d{3}\x02?\\)?[-.\\s]?\x01?\\d{3}\x02?[-.\\s]?\x01?\\d{4}\x02(?:\\s?x\x01\\d+\x02)?)"


def _label(labels: tuple[str, ...], more: str = "") -> str:
    return r"\b(?i:" + alternation(labels) + ")" + more + detect.SEPARATOR


def hits(source: str, profile: Profile | None = None) -> dict[str, str]:
    """Name of a detector -> CTEs that end in a table of that name with the columns of a hit."""
    profile = profile or Profile()
    words = ", ".join(_quoted(w) for w in profile.label_words)
    boxes = ", ".join(_quoted(m) for m in profile.shared_mailboxes)
    digits = r"regexp_replace(regexp_replace(regexp_replace(value, '(?i)\s?(?:x|ext\.?)\s?\d+\s*$', ''), '\D', '', 'g'), '^00', '')"
    luhn = "(list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 1 THEN CASE WHEN CAST(v[i] AS INT) > 4 THEN 2 * CAST(v[i] AS INT) - 9 ELSE 2 * CAST(v[i] AS INT) END ELSE CAST(v[i] AS INT) END)) % 10 = 0)"
    first, any_ = r"(?i)\b(" + "|".join(detect.STREET_ABBREVIATIONS) + r")\.", detect.SENTENCE_OPENERS
    dotted = f"regexp_replace(text, {_quoted(first)}, '\\1' || chr(3), 'g')"
    ends = f"regexp_replace({dotted}, {_quoted('(?i)(' + f'[.{SHORT}]' + r'\s+(?:' + any_ + r')\b|\.\s+[A-Za-z]|' + f'[.{SHORT}]' + r'\n?\z)')}, chr(4) || '\\1', 'g')"
    colons = "regexp_replace(text, '([ \\t]*:)', chr(5) || '\\1', 'g')"
    label_name = "(?:" + _label(profile.name_labels) + ")"
    word = r"[A-Z][A-Za-z.'-]+"
    name = label_name + "(" + word + "(?:(?:, | )" + word + r"){1,3})(?:[ \n,;)]|$)"
    start = detect.ADDRESS_START.replace(r"\.?", f"{STOP}?[.{SHORT}]?")
    address = "(?i)(?:" + _label(profile.address_labels, f"{STOP}?").replace(r"\.{2,}", rf"\.+{STOP}?\.+") + ")(" + start + f"(?:{STOP}?[^\\n|{STOP}]){{9,119}}?)(?:{STOP}|\\n|\\||$)"
    account = "(?i)(?:" + _label(profile.account_labels) + r")(\d{6,17})(?:\D|$)"
    login = "(?i)(?:" + _label(profile.login_labels, f"{COLON}?") + f")([a-zA-Z0-9._-]{{4,40}})(?:[^A-Za-z0-9._{COLON}-]|$)"

    def hit(name: str, category: str, frame: str, raw: str = "raw", normalized: str = "value", confidence: str = "0.9", method: str = "deterministic_regex", partial: bool = False, suppressed: str = "false", keep: str = "true", value: str = "value") -> str:
        return frame + f",\n{name} AS (SELECT doc_id, '{name}' AS detector, {category} AS category, {value} AS raw_value, {normalized} AS normalized_value, {passage()} AS passage, CAST({confidence} AS DOUBLE) AS confidence, '{method}' AS method, {str(partial).lower()} AS is_partial, {suppressed} AS suppressed, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM {frame.split()[0].rsplit('_', 1)[0]} WHERE {keep})"

    def plain(name: str, pattern: str) -> str:
        """Matches of a pattern without lookaround: group 1 is the whole."""
        return found(f"f_{name}", source, f"({pattern})", 2 if "(" in pattern and name in ("ssn_partial", "card_masked", "ending_in", "passport") else 1).lstrip()

    def labelled(name: str, pattern: str, marked: str) -> str:
        """Matches whose offsets are those of label and value together: the label is part of what is replaced."""
        inner = pattern.replace("(?i)", "", 1) if pattern.startswith("(?i)") else pattern
        cut = inner.rindex("(?:")  # what follows the value is looked at only
        whole = ("(?i)" if pattern.startswith("(?i)") else "") + "(" + inner[:cut] + ")" + inner[cut:]
        return found(f"f_{name}", source, whole, 2, marked).lstrip()

    decoy = f"(regexp_matches({passage()}, {_quoted(detect.DECOY_PASSAGE)}) OR regexp_matches({before(40)}, {_quoted(detect.DECOY_LEAD_IN.replace('(?id)', '(?i)'))}) OR raw = '000-00-0000')"
    birth = f"regexp_matches(lower({passage()}), 'dob|birth|born')"
    age = "date_diff('day', try_cast(value AS DATE), DATE '2026-01-01') / 365.2425"
    v = r"regexp_replace(raw, '[ -]', '', 'g')"
    card = luhn.replace("(v)", f"({v})").replace("v[i]", f"({v})[i]")
    ten = f"(CASE WHEN length({digits}) > 10 AND {digits} LIKE '1%' THEN ({digits})[2:] ELSE {digits} END)"
    trimmed = r"regexp_replace(trim(value), '\.+$', '')"
    return {
        "ssn": hit("ssn", "'ssn'", plain("ssn", detect.SSN), suppressed=decoy, confidence=f"CASE WHEN {decoy} THEN 0.05 ELSE 0.97 END"),
        "ssn_partial": hit("ssn_partial", "'ssn'", plain("ssn_partial", detect.SSN_PARTIAL), confidence="0.6", partial=True),
        "email": hit("email", "'email'", plain("email", detect.EMAIL), normalized="lower(raw)", suppressed=f"lower(split_part(raw, '@', 1)) IN ({boxes})", confidence=f"CASE WHEN lower(split_part(raw, '@', 1)) IN ({boxes}) THEN 0.1 ELSE 0.95 END"),
        "phone": hit("phone", "'phone'", found("f_phone", source, PHONE, 1, _DIGITS).lstrip(), normalized=ten, confidence="0.85", keep=f"length({ten}) IN (10, 11) AND (regexp_matches(raw, {_quoted(detect.PHONE_WRITTEN)}) OR regexp_matches({before(24)}, {_quoted(detect.PHONE_WORDS)}))"),
        "dob": hit("dob", "'dob'", plain("dob", detect.BIRTH), confidence=f"CASE WHEN {birth} THEN 0.9 ELSE 0.4 END", keep=f"coalesce(try_cast(value AS DATE) <= DATE '2026-01-01' AND {age} <= 120 AND ({age} >= 16 OR {birth}), false)"),
        "card": hit("card", "'card_number'", plain("card", detect.CARD), normalized=v, method="deterministic_checksum", suppressed=f"{v} IN ({', '.join(map(_quoted, detect.TEST_CARDS))})", confidence=f"CASE WHEN {v} IN ({', '.join(map(_quoted, detect.TEST_CARDS))}) THEN 0.05 ELSE 0.98 END", keep=f"length({v}) IN (15, 16) AND {card}"),
        "card_masked": hit("card_masked", "'card_number'", plain("card_masked", detect.CARD_MASKED), confidence="0.6", partial=True),
        "ending_in": hit("ending_in", f"CASE WHEN contains(lower({before(40)}), 'card') THEN 'card_number' ELSE 'financial_account' END", plain("ending_in", detect.ENDING_IN), confidence="0.55", partial=True),
        "drivers_license": hit("drivers_license", "'drivers_license'", plain("drivers_license", detect.LICENSE), confidence=f"CASE WHEN regexp_matches(lower({passage()}), 'license|dl') THEN 0.9 ELSE 0.3 END"),
        "passport": hit("passport", "'passport'", plain("passport", detect.PASSPORT)),
        "name": hit("name", "'full_name'", labelled("name", name, "text"), value="trim(value)", normalized="trim(value)", confidence="0.85", keep="trim(value) <> 'John Doe'"),
        "address": hit("address", "'home_address'", labelled("address", address, ends), value=trimmed, normalized=trimmed, confidence="0.8"),
        "account": hit("account", "'financial_account'", labelled("account", account, "text"), confidence="0.75"),
        "login": hit("login", "'login_credentials'", labelled("login", login, colons), confidence="0.7", keep=f"lower(trim(value)) NOT IN ({words})"),
    }


def every(source: str, profile: Profile | None = None, names: list[str] | None = None) -> str:
    """``WITH`` clauses for the table ``hits`` of all detectors, or of those named."""
    h = {k: x for k, x in hits(source, profile).items() if names is None or k in names}
    return ",\n".join(h.values()) + ",\nhits AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in h) + ")"
