"""Checks of request bodies against the target's contract.

A body is a mapping from field names to columns; a field that isn't there is
null. Checks are expressions, so a body is judged where its row lies. The order
of the messages is that of the checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, limits and days that the target accepts.
PHONE = r"^(?:\+44)?[0-9 ]{10,20}$"
EMAIL = r"^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
ADDRESS_TEXT = r"^[A-Za-z0-9 ()':,.-]+$"
TOILET_TEXT = r"^[A-Za-z0-9 ()':,\-;.]+$"
EXPLANATION_TEXT = r"^[A-Za-z0-9 '\-()&+]*$"
TIME = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]$"
UNSUPPORTED_AREAS = {"BT": "Northern Ireland", "IM": "the Isle of Man", "JE": "Jersey", "GY": "Guernsey"}
OPENING_DAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "EVERYDAY"]
MOST_TEXT, MOST_TOWN, MOST_EXPLANATION, MOST_ROOMS = 255, 100, 250, 150
WITH_PHONES = {"accessibility_options": ["accessibleParkingPhoneNumber", "accessibleEntrancePhoneNumber", "liftSupportPhoneNumber"], "contact_detail": ["phoneNumber"]}
PROFESSIONAL = ["interviewRooms", "videoHearings", "commonPlatform", "accessScheme"]

# Fields that the target requires.
REQUIRED = {
    "building_facilities": ["courtId", "parking", "freeWaterDispensers", "snackVendingMachines", "drinkVendingMachines", "cafeteria", "waitingArea", "quietRoom", "babyChanging", "wifi"],
    "accessibility_options": ["courtId", "accessibleParking", "accessibleEntrance", "hearingEnhancementEquipment", "lift", "quietRoom"],
    "translation_services": ["courtId"],
    "counter_service_opening_hours": ["courtId", "counterService", "assistWithForms", "assistWithDocuments", "assistWithSupport", "appointmentNeeded"],
    "address": ["courtId", "addressLine1", "townCity", "postcode", "addressType"],
    "contact_detail": ["courtId", "courtContactDescriptionId"],
    "court_opening_hours": ["courtId", "openingHourTypeId"],
}
Rule = tuple[Column, str]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _unlike(c: Column, pattern: str) -> Column:
    return F.coalesce(~c.rlike(pattern), F.lit(False))


def period_errors(details: Column, required: bool) -> Column:
    """Messages of an array of opening periods (dayOfWeek, openingTime, closingTime); no periods are wrong only where they are required."""
    days = F.transform(details, lambda d: d["dayOfWeek"])
    good = lambda c: F.coalesce(c.rlike(TIME), F.lit(False))

    def each(d: Column, k: Column) -> Column:
        known = F.coalesce(d["dayOfWeek"].isin(OPENING_DAYS), F.lit(False))
        a, b = good(d["openingTime"]), good(d["closingTime"])
        return F.array_compact(F.array(
            F.when(~known, "openingTimesDetails has an unknown day").when(F.array_position(days, d["dayOfWeek"]) <= k, "openingTimesDetails has a day twice"),
            F.when(~a, "openingTimesDetails has an invalid opening time"), F.when(~b, "openingTimesDetails has an invalid closing time"),
            F.when(a & b & (d["openingTime"] >= d["closingTime"]), "openingTimesDetails closes before it opens"),
        ))

    every = F.when(F.array_contains(days, "EVERYDAY") & (F.size(days) > 1), F.array(F.lit("openingTimesDetails has other days beside EVERYDAY"))).otherwise(F.array().cast("array<string>"))
    nothing = F.array(F.lit("openingTimesDetails is required")) if required else F.array().cast("array<string>")
    return F.when(details.isNull() | (F.size(details) == 0), nothing).otherwise(F.concat(F.flatten(F.transform(details, each)), every))


def errors(resource: str, body: dict[str, Column], required_periods: bool = False) -> Column:
    """All messages of a body, in order; an empty array for a body that the target takes."""
    none = F.lit(None).cast("string")
    get = lambda f: body.get(f, none)
    rules: list[Rule] = [(get(f).isNull(), f"{f} is required") for f in REQUIRED.get(resource, [])]
    if resource == "building_facilities":
        rules.append((_true(get("waitingArea")) & get("waitingAreaChildren").isNull() if "waitingArea" in body else F.lit(False), "waitingAreaChildren is required when waitingArea is true"))
    rules += [(_unlike(get(f), PHONE), f"{f} is not a phone number") for f in WITH_PHONES.get(resource, [])]
    if resource == "accessibility_options" and "lift" in body:
        rules += [(_true(body["lift"]) & get(f).isNull(), f"{f} is required when lift is true") for f in ("liftDoorWidth", "liftDoorLimit")]
    if resource == "address":
        rules += [(_unlike(get(f), ADDRESS_TEXT), f"{f} has characters that are rejected") for f in ("addressLine1", "addressLine2", "townCity", "county")]
        rules += [(F.coalesce(F.length(get(f)) > MOST_TOWN, F.lit(False)), f"{f} is too long") for f in ("townCity", "county")]
        compact = F.upper(F.regexp_replace(get("postcode"), r"\s+", ""))
        outside = F.lit(False)
        for area, place in UNSUPPORTED_AREAS.items():
            rules.append((_true(compact.startswith(area)), f"postcode is in {place}, which is not served"))
            outside = outside | _true(compact.startswith(area))
        rules.append((_true(~F.trim(get("postcode")).contains(" ")) & ~outside, "postcode has no space"))
    if resource == "contact_detail":
        rules.append((_unlike(get("email"), EMAIL), "email is not an e-mail address"))
    periods = F.array().cast("array<string>")
    if resource in ("counter_service_opening_hours", "court_opening_hours"):
        periods = period_errors(body["openingTimesDetails"], required_periods) if "openingTimesDetails" in body else F.array(F.lit("openingTimesDetails is required")) if required_periods else periods
    late: list[Rule] = []
    if resource == "counter_service_opening_hours":
        needed = _true(body["appointmentNeeded"]) if "appointmentNeeded" in body else F.lit(False)
        late += [(needed & get("appointmentContact").isNull(), "appointmentContact is required when appointmentNeeded is true"), (_unlike(get("appointmentContact"), EMAIL), "appointmentContact is not an e-mail address")]
    texts = [f for f in body if f in ("addressLine1", "addressLine2", "townCity", "county", "postcode", "explanation", "email", "phoneNumber", "accessibleToiletDescription", "appointmentContact", *WITH_PHONES["accessibility_options"])]
    late += [(F.coalesce(F.length(body[f]) > MOST_TEXT, F.lit(False)), f"{f} is too long") for f in texts]
    if resource == "accessibility_options":
        late.append((_unlike(F.nullif(get("accessibleToiletDescription"), F.lit("")), TOILET_TEXT), "accessibleToiletDescription has characters that are rejected"))
    if resource == "contact_detail":
        late += [(F.coalesce(F.length(get("explanation")) > MOST_EXPLANATION, F.lit(False)), "explanation is too long for a contact"), (_unlike(get("explanation"), EXPLANATION_TEXT), "explanation has characters that are rejected")]
    if resource == "professional_information":
        late += [(get(f).isNull(), f"{f} is required") for f in PROFESSIONAL]
        rooms, count = get("interviewRooms").cast("boolean"), get("interviewRoomCount").cast("int")
        late += [(_true(rooms) & ~F.coalesce(count.between(1, MOST_ROOMS), F.lit(False)), f"interviewRoomCount must be 1 to {MOST_ROOMS} when interviewRooms is true"), (_true(~rooms) & F.coalesce(count != 0, F.lit(False)), "interviewRoomCount must be left out or 0 when interviewRooms is false")]
    said = lambda rs: F.array_compact(F.array(*[F.when(t, m) for t, m in rs])) if rs else F.array().cast("array<string>")
    return F.concat(said(rules), periods, said(late))


def reason(resource: str, body: dict[str, Column], required_periods: bool = False) -> Column:
    """The messages as one text; empty where there are none."""
    return F.array_join(errors(resource, body, required_periods), "; ")


def empty_contact(body: dict[str, Column], cleared: Column) -> Column:
    """Whether a contact says nothing and clears nothing, so that it is left out."""
    return ~cleared & F.coalesce(*[F.nullif(body[f], F.lit("")) for f in ("phoneNumber", "email", "explanation")]).isNull()
