"""Small invented feed items in the shape of the public feed."""

import json
from pathlib import Path


def node(n: int) -> str:
    return f"{n:064x}"


def station(n: int, **changes):
    item = {
        "node_id": node(n),
        "public_phone_number": None,
        "trading_name": f"Garage {n}",
        "is_same_trading_and_brand_name": False,
        "brand_name": "BRAND",
        "temporary_closure": False,
        "permanent_closure": None,
        "permanent_closure_date": None,
        "is_motorway_service_station": False,
        "is_supermarket_service_station": None,
        "location": {
            "address_line_1": f"{n} Some Road", "address_line_2": "", "city": "TOWN", "country": None,
            "county": "", "postcode": f"AB{n} 1CD", "latitude": 51.5, "longitude": -1,
        },
        "amenities": ["toilets"],
        "opening_times": {"usual_days": {"monday": {"open": "06:00:00"}}},
        "fuel_types": ["E10", "B7_STANDARD"],
    }
    item.update(changes)
    return item


def price(fuel="E10", amount=140.9, updated="2026-03-01T10:00:00.123Z", effective="2026-03-01T09:00:00.000Z", **changes):
    item = {
        "fuel_type": fuel, "price": amount, "price_last_updated": updated,
        "price_change_effective_timestamp": effective,
    }
    item.update(changes)
    return item


def prices(n: int, *rows, **changes):
    item = {"node_id": node(n), "public_phone_number": "", "trading_name": f"Garage {n}", "fuel_prices": list(rows)}
    item.update(changes)
    return item


def land(folder: Path, number: int, content) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    body = content if isinstance(content, str) else json.dumps(content)
    (folder / f"page-{number:05d}.json").write_text(body)
