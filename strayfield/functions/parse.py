"""Feed values to canonical ones. Each family of feeds reads some values its own way; the differences are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upper(c: Column) -> Column:
    return F.upper(F.trim(c))


def _any(c: Column, *parts: str) -> Column:
    """Whether a string contains one of ``parts``."""
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


def _map(c: Column, values: dict[str, str], otherwise: str | None) -> Column:
    out = F.lit(otherwise)
    for value in dict.fromkeys(values.values()):
        out = F.when(c.isin([k for k, v in values.items() if v == value]), value).otherwise(out)
    return out


def species(c: Column) -> Column:
    """dog, cat or null: the row is then rejected."""
    return _map(_upper(c), {"DOG": "dog", "CANINE": "dog", "CAT": "cat", "FELINE": "cat"}, None)


#: What each family of feeds takes for an intake type.
INTAKE = {
    "flat": {"STRAY": "stray", "OWNER SURRENDER": "owner_surrender", "OWNER_SURRENDER": "owner_surrender", "FOUND REPORT": "found_report", "FOUND_REPORT": "found_report", "TRANSFER": "transfer"},
    "nested": {"STRAY": "stray", "WILDLIFE": "stray", "CONFISCATED": "stray", "FIELD": "stray", "FOUND": "found_report", "FOUND REPORT": "found_report", "FOUND_REPORT": "found_report"},
    "geojson": {"STRAY": "stray", "STRAY INCOMING": "stray", "WILDLIFE": "stray", "CONFISCATED": "stray", "FIELD": "stray", "FOUND": "found_report", "FOUND REPORT": "found_report", "FOUND_REPORT": "found_report"},
}


def intake_type(c: Column, family: str) -> Column:
    return _map(_upper(F.coalesce(c, F.lit(""))), INTAKE[family], "unknown")


def is_stray(c: Column) -> Column:
    """Whether an intake value names a stray, in any wording."""
    return F.coalesce(_upper(c).rlike("STRAY|FOUND|FIELD|CONFISCATED|WILDLIFE"), F.lit(False))


def availability(outcome: Column, kennel: Column, family: str) -> Column:
    """An outcome comes first; a kennel status is then read by what it contains, so that UNAVAILABLE is adoptable in two families and
    ADOPTED in the third."""
    k = F.upper(F.coalesce(kennel, F.lit("")))
    gone = F.coalesce(outcome, F.lit("")) != ""
    if family == "geojson":
        number = outcome.try_cast("bigint") if hasattr(outcome, "try_cast") else outcome.cast("bigint")
        gone = F.when(number.isNotNull(), number > 0).otherwise(gone)
        return F.when(gone, "departed").when(_any(k, "ADOPT"), "adoptable").otherwise("in_custody")
    return F.when(gone | _any(k, "ADOPTED", "TRANSFERRED", "DIED"), "departed").when(_any(k, "AVAILABLE", "ADOPT"), "adoptable").otherwise("in_custody")


def chip(c: Column, family: str) -> Column:
    """scanned, scan_no_chip, not_scanned or unknown. Everything that contains NO, UNKNOWN among it, is no chip, but for the exact reading of one family."""
    u = _upper(F.coalesce(c, F.lit("")))
    if family == "geojson":
        return _map(u, {"YES": "scanned", "SCANNED": "scanned", "MICROCHIPPED": "scanned", "NO": "not_scanned", "NONE": "not_scanned"}, "unknown")
    yes = _any(u, "YES", "SCANNED", "CHIP") if family == "jsonapi" else _any(u, "YES", "SCANNED")
    return F.when(yes & ~_any(u, "NO"), "scanned").when(_any(u, "NO"), "scan_no_chip").otherwise("unknown")


def sex(c: Column) -> Column:
    low = F.lower(c)
    found = _map(low, {"male": "male", "m": "male", "female": "female", "f": "female", "neutered male": "neutered_male", "neutered": "neutered_male", "spayed female": "spayed_female", "spayed": "spayed_female"}, "unknown")
    return F.when(c.isNotNull(), found)


def age(c: Column, strict: bool) -> Column:
    """strict: whole words only, else null; lenient: what is contained, else adult."""
    low = F.lower(c)
    if strict:
        return _map(low, {"baby": "baby", "puppy": "baby", "kitten": "baby", "young": "young", "juvenile": "young", "adult": "adult", "senior": "senior", "older": "senior"}, None)
    found = F.when(_any(low, "baby", "puppy", "kitten"), "baby").when(_any(low, "young", "juvenile"), "young").when(_any(low, "adult"), "adult").when(_any(low, "senior", "older"), "senior").otherwise("adult")
    return F.when(c.isNotNull(), found)


def size(c: Column, strict: bool) -> Column:
    low = F.lower(c)
    if strict:
        return _map(low, {"extra large": "extra_large", "x-large": "extra_large", "xlarge": "extra_large", "xl": "extra_large", "large": "large", "l": "large", "medium": "medium", "m": "medium", "small": "small", "s": "small"}, None)
    found = F.when(_any(low, "extra large", "x-large", "xlarge"), "extra_large").when(_any(low, "large"), "large").when(_any(low, "medium"), "medium").otherwise("small")
    return F.when(c.isNotNull(), found)


def timestamp(c: Column, slashes: bool = False, epoch_ms: bool = False) -> Column:
    """ISO forms with T or a space, fraction, offset or date only; with the flags also 2024/01/31 10:00:00 and milliseconds. Else null."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(c))
    forms = [iso]
    if slashes:
        forms.append(F.when(c.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy/MM/dd HH:mm:ss"))))
    if epoch_ms:
        forms.append(F.when(c.rlike(r"^-?\d{1,15}$"), F.timestamp_millis(F.when(c.rlike(r"^-?\d{1,15}$"), c).cast("bigint"))))
    return F.coalesce(*forms)


#: Postal codes of states, districts and territories.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC AS GU MP PR VI".split()


def place(text: Column) -> dict[str, Column]:
    """zip: the last token of five digits; city and state: of the last two comma parts, or without a comma of the words before a final state code."""
    t = F.trim(F.coalesce(text, F.lit("")))
    tokens = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    zips = F.filter(tokens, lambda x: x.rlike("^[0-9]{5}$"))
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    comma = t.contains(",")
    state = F.upper(F.when(comma, F.try_element_at(parts, F.lit(-1))).otherwise(F.try_element_at(tokens, F.lit(-1))))
    n = F.size(tokens)
    city = F.when(comma, F.try_element_at(parts, F.lit(-2))).when(n >= 2, F.array_join(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), " "))
    known = state.isin(STATES) & city.isNotNull()
    return {"zip": F.try_element_at(zips, F.lit(-1)), "city": F.when(known, F.lower(city)), "state": F.when(known, state)}
