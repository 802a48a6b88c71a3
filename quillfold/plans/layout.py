"""Where every answer stands in the wide sheet: 204 columns, built from their rule."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources.sheets import column_letters

# Field names in column order.
METADATA = ["forms_id", "start_time", "completion_time", "submitter_email", "submitter_name", "last_modified_time"]
SCALARS = [
    "court_slug_raw", "accessible_parking", "accessible_parking_phone", "accessible_toilet_description", "accessible_entrance", "accessible_entrance_support_phone",
    "hearing_enhancement_equipment", "lift_available", "lift_door_width", "lift_weight_limit", "quiet_room_available", "parking_available", "food_and_drink",
    "separate_waiting_areas", "child_waiting_area", "quiet_room_available_2", "baby_changing", "wifi_available", "translation_phone", "translation_email",
]
ADDRESS = ["address_type", "line_1", "line_2", "town_or_city", "county", "postcode", "areas_of_law", "court_types", "add_another"]
COUNTER = ["specific_courts", "assists_with", "appointment_contact", "same_monday_to_friday"]
ROOMS = ["has_interview_rooms", "room_count", "booking_phone"]
CONTACT = ["description", "explanation", "phone", "email", "add_another"]
TIMES = ["opening_hour", "opening_minute", "closing_hour", "closing_minute"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
BOOLEANS = ["accessible_parking", "accessible_entrance", "lift_available", "quiet_room_available", "parking_available", "separate_waiting_areas", "child_waiting_area", "quiet_room_available_2", "baby_changing", "wifi_available"]
PHONES = ["accessible_parking_phone", "accessible_entrance_support_phone"]
ADDRESS_GROUPS, CONTACT_GROUPS, HOURS_GROUPS = 5, 10, 2


@dataclass(frozen=True)
class Field:
    section: str
    index: int  # of the repeated group, from 1; 0 outside of groups
    name: str
    column: str


def layout() -> list[Field]:
    """All fields in column order."""
    day_times = [f"{d}_{t}" for d in DAYS for t in TIMES]
    names = [("metadata", 0, f) for f in METADATA] + [("scalar", 0, f) for f in SCALARS]
    for k in range(1, ADDRESS_GROUPS + 1):
        names += [("address", k, f) for f in (ADDRESS if k < ADDRESS_GROUPS else ADDRESS[:-1])]
    names += [("counter_service", 0, f) for f in [*COUNTER, *TIMES, *day_times]] + [("interview_rooms", 0, f) for f in ROOMS]
    for k in range(1, CONTACT_GROUPS + 1):
        names += [("contact", k, f) for f in (CONTACT if k < CONTACT_GROUPS else CONTACT[:-1])]
    for k in range(1, HOURS_GROUPS + 1):
        more = k < HOURS_GROUPS
        names += [("opening_hours", k, f) for f in ["type", "same_monday_to_friday", *TIMES, *["add_another"] * more, *day_times, *["add_another_after_days"] * more]]
    return [Field(s, k, f, column_letters(i)) for i, (s, k, f) in enumerate(names)]


LAYOUT = layout()
BUSINESS = [f for f in LAYOUT if f.section != "metadata" and not f.name.startswith("add_another")]


def column_of(section: str, name: str, index: int = 0) -> str:
    return next(f.column for f in LAYOUT if (f.section, f.index, f.name) == (section, index, name))
