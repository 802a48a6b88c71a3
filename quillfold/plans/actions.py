"""From records to an ordered plan of typed actions, their readiness and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import summaries
from . import contract
from .validate import ids_of

# Resources in plan order, their methods, and the fields that the target's contract requires.
RESOURCES = [("building_facilities", "POST"), ("accessibility_options", "POST"), ("translation_services", "POST"), ("professional_information", "POST"), ("counter_service_opening_hours", "PUT"), ("address", "POST"), ("contact_detail", "POST"), ("court_opening_hours", "PUT")]
# Address types of the form and of the target, texts that say there is no counter service, and what the form doesn't ask.
ADDRESS_TYPES = {"Visit": "VISIT_US", "Send documents to": "WRITE_TO_US", "Visit and send documents to": "VISIT_OR_CONTACT_US"}
NO_COUNTER = ["no counter service", "no counter service available", "counter service not available"]
NOT_ASKED = {"videoHearings": False, "commonPlatform": False, "accessScheme": False}


def opening_times(hours: Column, strict: bool) -> Column:
    """Day rows of an hours struct: EVERYDAY or the weekdays, valid times only; strict also wants the start before the end."""
    days = [("monday_to_friday", "EVERYDAY"), *[(d, d.upper()) for d in ("monday", "tuesday", "wednesday", "thursday", "friday")]]
    rows = F.array(*[F.struct(F.lit(n).alias("dayOfWeek"), hours[d]["open"].alias("openingTime"), hours[d]["close"].alias("closingTime"), hours[d]["status"].alias("status")) for d, n in days])

    def good(t: Column) -> Column:
        ok = (t["status"] == "valid_time") & t["openingTime"].isNotNull() & t["closingTime"].isNotNull() & ~((t["openingTime"] == "00:00") & (t["closingTime"] == "00:00"))
        return ok & (t["openingTime"] < t["closingTime"]) if strict else ok

    kept = F.transform(F.filter(rows, good), lambda t: F.struct(t["dayOfWeek"].alias("dayOfWeek"), t["openingTime"].alias("openingTime"), t["closingTime"].alias("closingTime")))
    return F.when(F.exists(kept, lambda t: t["dayOfWeek"] == "EVERYDAY"), F.filter(kept, lambda t: t["dayOfWeek"] == "EVERYDAY")).otherwise(kept)


def _action(resource: str, item: Column, body: dict[str, Column], empty: Column, *reasons: Column, notes: dict[str, Column] | None = None) -> Column:
    """An action with its body as JSON, what is wrong with it (own reasons, then those of the contract), and the assumptions it rests on; null where the section is empty."""
    order = [r for r, _ in RESOURCES].index(resource)
    full = {**({} if resource == "professional_information" else {"courtId": F.col("court_id")}), **body}
    sent = {"professionalInformation": F.struct(*[v.alias(k) for k, v in body.items()])} if resource == "professional_information" else full
    said = F.concat_ws("; ", *[F.nullif(r, F.lit("")) for r in (*reasons, contract.reason(resource, full))])
    assumed = F.array_compact(F.array(*[F.when(t, n) for n, t in (notes or {}).items()])) if notes else F.array().cast("array<string>")
    return F.when(~empty, F.struct(F.lit(order).alias("section"), item.cast("int").alias("item"), F.lit(resource).alias("resource"), F.lit(RESOURCES[order][1]).alias("method"), F.to_json(F.struct(*[v.alias(k) for k, v in sent.items()])).alias("body"), said.alias("reason"), assumed.alias("assumptions")))


def _phone(c: Column) -> Column:
    """A phone number that the target takes, or none."""
    return F.when(c.rlike(contract.PHONE), c)


def plan(records: DataFrame, vocabularies: DataFrame | None = None, verifications: DataFrame | None = None) -> DataFrame:
    """Actions of all records with a known key, numbered in section order; empty sections give none.

    Items of a collection are made inside the row; ids count only what is there.
    With vocabularies, types and kinds become the target's ids (lists are configuration
    of a checked size); without, they stay as they are. With verifications (row, index,
    status), an address that one blocks waits with its reason.
    """
    lookup = ids_of(vocabularies)
    f, has = F.col("facilities"), F.array_contains
    known = records.filter(F.col("court_slug").isNotNull() & (F.col("status") != "skipped") & ~F.exists("issues", lambda i: i["code"] == "COURT_SLUG_NOT_FOUND"))
    food = F.transform(f["food_and_drink"], F.lower)
    some = lambda *cs: F.coalesce(*[c.cast("string") for c in cs]).isNull()
    option = lambda name: has(food, name)
    building = {
        "parking": f["parking_available"], "freeWaterDispensers": option("free water dispensers"), "snackVendingMachines": option("snack vending machines"), "drinkVendingMachines": option("drink vending machines"), "cafeteria": option("cafeteria"),
        "waitingArea": f["separate_waiting_areas"], "waitingAreaChildren": f["child_waiting_area"], "quietRoom": f["quiet_room_available_2"], "babyChanging": f["baby_changing"], "wifi": f["wifi_available"],
    }
    access = {
        "accessibleParking": f["accessible_parking"], "accessibleParkingPhoneNumber": f["accessible_parking_phone"], "accessibleToiletDescription": T.api_text(f["accessible_toilet_description"]), "accessibleEntrance": f["accessible_entrance"],
        "accessibleEntrancePhoneNumber": f["accessible_entrance_support_phone"], "hearingEnhancementEquipment": f["hearing_enhancement_equipment"], "lift": f["lift_available"],
        "liftDoorWidth": F.when(f["lift_available"], T.measurement(f["lift_door_width"], T.WIDTH_UNITS, F.lit(1))), "liftDoorLimit": F.when(f["lift_available"], T.measurement(f["lift_weight_limit"], T.WEIGHT_UNITS, F.lit(1))), "quietRoom": f["quiet_room_available"],
    }
    rooms = F.col("interview_rooms")
    counter = F.col("counter_service")
    assists = F.transform(counter["assists_with"], F.lower)
    unserved = F.lit(False)
    for d in ("monday_to_friday", "monday", "tuesday", "wednesday", "thursday", "friday"):
        unserved = unserved | F.coalesce(F.lower(counter[d]["open"]).isin(NO_COUNTER) | F.lower(counter[d]["close"]).isin(NO_COUNTER), F.lit(False))
    counter_times = F.when(unserved, F.array().cast("array<struct<dayOfWeek:string,openingTime:string,closingTime:string>>")).otherwise(opening_times(counter, True))
    appointment = F.when(counter["appointment_contact"].rlike(contract.EMAIL) & ~unserved, counter["appointment_contact"])
    courts, court_reason = lookup("court_types", counter["specific_courts"])
    zero = F.lit(0)
    single = F.array(
        _action("building_facilities", zero, building, some(*[f[c] for c in ("parking_available", "separate_waiting_areas", "child_waiting_area", "quiet_room_available_2", "baby_changing", "wifi_available")]) & (F.size(food) == 0)),
        _action("accessibility_options", zero, access, some(*[f[c] for c in ("accessible_parking", "accessible_entrance", "hearing_enhancement_equipment", "lift_available", "quiet_room_available", "accessible_toilet_description")])),
        _action("translation_services", zero, {"phoneNumber": F.col("translation_phone"), "email": F.col("translation_email")}, some(F.col("translation_phone"), F.col("translation_email"))),
        _action("professional_information", zero, {"interviewRooms": rooms["has_interview_rooms"], "interviewRoomCount": T.room_count(rooms["room_count"], rooms["has_interview_rooms"]), "interviewPhoneNumber": _phone(rooms["booking_phone"]), **{k: F.lit(v) for k, v in NOT_ASKED.items()}}, some(rooms["has_interview_rooms"], rooms["room_count"], rooms["booking_phone"]),
                notes={"what the form does not ask is false": F.lit(True), "rooms without a usable number count as one": rooms["has_interview_rooms"] & ~F.coalesce(rooms["room_count"].rlike("[0-9]"), F.lit(False))}),
        _action(
            "counter_service_opening_hours", zero,
            {"counterService": ~unserved, "assistWithForms": has(assists, "forms"), "assistWithDocuments": has(assists, "documents"), "assistWithSupport": has(assists, "support at court"), "appointmentNeeded": appointment.isNotNull(), "appointmentContact": appointment, "courtTypes": courts, "openingTimesDetails": counter_times},
            (F.size(counter_times) == 0) & (F.size(assists) == 0) & appointment.isNull() & ~unserved,
            court_reason, F.when(unserved & (F.size(assists) > 0), "there is no counter service, but help is offered"),
        ),
    )
    def address(a: Column) -> Column:
        areas, area_reason = lookup("areas_of_law", a["areas_of_law"])
        kinds, kind_reason = lookup("court_types", a["court_types"])
        kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in ADDRESS_TYPES.items() for x in pair]), a["address_type"]) if vocabularies is not None else a["address_type"]
        unknown = F.when(a["address_type"].isNotNull() & kind.isNull(), "the address type is not known")
        body = {"addressLine1": T.api_text(a["line_1"]), "addressLine2": T.api_text(a["line_2"]), "townCity": T.api_text(a["town_or_city"]), "county": T.api_text(a["county"]), "postcode": a["postcode"], "addressType": kind, "areasOfLaw": areas, "courtTypes": kinds}
        blocked = F.try_element_at(F.col("_blocked"), a["index"]) if verifications is not None else F.lit(None).cast("string")
        return _action("address", a["index"], body, F.lit(False), blocked, area_reason, kind_reason, unknown)

    def contact(c: Column) -> Column:
        ids, why = lookup("contact_description_types", F.array(c["description"]))
        body = {"courtContactDescriptionId": F.get(ids, F.lit(0)), "explanation": T.api_text(c["explanation"]), "email": F.when(c["email"].rlike(contract.EMAIL), c["email"]), "phoneNumber": _phone(c["phone"])}
        return _action("contact_detail", c["index"], body, some(c["phone"], c["email"], c["explanation"]), why)

    def hours_of(h: Column) -> Column:
        ids, why = lookup("opening_hour_types", F.array(h["type"]))
        times = opening_times(h, False)
        nothing = F.coalesce(F.lower(F.trim(h["type"])).isin(NO_COUNTER), F.lit(False)) & (F.size(times) == 0)
        return _action("court_opening_hours", h["index"], {"openingHourTypeId": F.get(ids, F.lit(0)), "openingTimesDetails": times}, nothing, why, F.when(F.size(times) == 0, "there is no valid opening period"))

    if verifications is not None:
        from ..operators import addresses as A

        why = verifications.select(F.col("row").alias("source_row_number"), "index", A.reason(F.col("status")).alias("_why")).filter("_why is not null").dropDuplicates(["source_row_number", "index"])
        known = known.join(why.groupBy("source_row_number").agg(F.map_from_entries(F.collect_list(F.struct("index", "_why"))).alias("_blocked")), "source_row_number", "left")
    addresses, contacts, hours = F.transform("addresses", address), F.transform("contacts", contact), F.transform("opening_hours", hours_of)
    each = known.select("source_row_number", "court_slug", F.explode(F.array_compact(F.concat(single, addresses, contacts, hours))).alias("a")).select("source_row_number", "court_slug", "a.*")
    number = F.row_number().over(W.partitionBy("source_row_number").orderBy("section", "item"))
    return each.withColumn("action_id", F.concat("court_slug", F.lit("-"), F.lpad(number.cast("string"), 3, "0"))).withColumn("readiness", F.when(F.col("reason") == "", "ready").otherwise("pending"))


def record_readiness(actions: DataFrame) -> DataFrame:
    got = actions.groupBy("court_slug").agg(F.count("*").alias("actions"), F.count_if(F.col("readiness") == "ready").alias("ready"))
    return got.withColumn("readiness", summaries.readiness(F.col("actions"), F.col("ready")))


def fold_collections(actions: DataFrame) -> DataFrame:
    """Items of a collection as one section action: bodies in item order, reasons once each, the worst readiness, the first id."""
    item = F.struct("item", "action_id", "body", "reason")
    got = actions.groupBy("court_slug", "source_row_number", "section", "resource", "method").agg(F.array_sort(F.collect_list(item)).alias("l"), F.max(F.col("readiness") != "ready").alias("bad"))
    return got.select("court_slug", "source_row_number", "section", "resource", "method", F.get("l", F.lit(0))["action_id"].alias("action_id"), F.transform("l", lambda x: x["body"]).alias("bodies"), F.array_join(F.array_distinct(F.filter(F.transform("l", lambda x: x["reason"]), lambda r: r != "")), "; ").alias("reason"), F.when(F.col("bad"), "pending").otherwise("ready").alias("readiness"))
