"""The invented world: settings, time line, and the small tables that everything else refers to."""

from __future__ import annotations

import random
from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property
from pathlib import Path

import yaml

WHEELS = 80_000  # vehicles that a day can have; keeps serial numbers within eight digits
SLOTS = 1024  # of a region's table of dealers
TRACKED = ("Brakes", "Drive", "Electrical", "Infotainment", "Suspension", "Body")


def load_settings(path: str | Path | None = None) -> dict:
    return yaml.safe_load(Path(path or Path(__file__).with_name("settings.yaml")).read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Trim:
    model_id: int
    model: str
    brand: str
    maker: str
    body: str
    segment: str
    trim: str
    powertrain: str
    litres: float | None
    kwh: float | None
    range_km: int | None
    fuel: float | None
    price: int
    first: int
    last: int | None
    weight: float


class World:
    def __init__(self, preset: str = "test", seed: int | None = None, settings: dict | None = None, **changes):
        self.s = settings or load_settings()
        if preset not in self.s["presets"]:
            raise ValueError(f"unknown preset {preset!r}; known: {', '.join(self.s['presets'])}")
        self.preset, self.seed = preset, self.s["seed"] if seed is None else seed
        self.size = self.s["presets"][preset] | changes
        end = self.s["end_date"]
        self.end = end if isinstance(end, date) else date.fromisoformat(str(end))
        self.start = self.end.replace(year=self.end.year - self.s["history_years"]) + timedelta(days=1)
        self.horizon = self.end + timedelta(days=self.s["day_horizon_days"])

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def at(self, share: float) -> date:
        """A day of the history by its share of it."""
        return self.start + timedelta(days=int(share * self.days))

    @cached_property
    def trims(self) -> list[Trim]:
        rows = [(m, *about[:4], *t) for m, about in self.s["models"].items() for t in about[4]]
        return [Trim(k, *r) for k, r in enumerate(rows, 1)]

    @cached_property
    def suppliers(self) -> dict[str, int]:
        return {s[0]: k for k, s in enumerate(self.s["suppliers"], 1)}

    @cached_property
    def plants(self) -> dict[str, int]:
        return {p[0]: k for k, p in enumerate(self.s["plants"], 1)}

    @cached_property
    def parts(self) -> dict[str, int]:
        return {p[0]: k for k, p in enumerate(self.s["parts"], 1)}

    def part(self, part_id: int) -> list:
        return self.s["parts"][part_id - 1]

    def parts_of(self, t: Trim) -> list[int]:
        """A vehicle's tracked parts: one of each category; plug-ins and electric ones have a battery in place of an engine."""
        drive = "Battery" if t.powertrain in ("PHEV", "BEV") else "Powertrain"
        fits = lambda p, category: p[1] == category and (not p[6] or t.model in p[6]) and (not p[7] or t.powertrain in p[7])
        return [next(k for k, p in enumerate(self.s["parts"], 1) if fits(p, drive if c == "Drive" else c)) for c in TRACKED]

    @cached_property
    def supplied(self) -> list[tuple[int, int]]:
        """(part, plant) of everything that is built in."""
        return sorted({(p, k) for k, plant in enumerate(self.s["plants"], 1) for t in self.trims if t.model in plant[6] for p in self.parts_of(t)})

    @cached_property
    def defect_window(self) -> tuple[date, date]:
        """The weeks of the bad batches: first day, and the first day after."""
        p = self.s["patterns"]["p1"]
        first = self.at(p["window_start"])
        return first, first + timedelta(weeks=p["weeks"])

    @cached_property
    def dealers(self) -> list[dict]:
        """All dealers; the first of each region has always been open, and a few are slow to sell."""
        rng, s, out = random.Random(f"{self.seed} dealers"), self.s, []
        total = self.size["dealers"]
        for region, about in s["regions"].items():
            for k in range(max(3, round(total * about["weight"]))):
                country = rng.choices(list(about["countries"]), [c[0] for c in about["countries"].values()])[0]
                city = rng.choice(about["countries"][country][1:])
                tier = rng.choices(list(s["dealers"]["tiers"]), [t[0] for t in s["dealers"]["tiers"].values()])[0]
                opened, closed = date(rng.randint(1985, 2018), rng.randint(1, 12), rng.randint(1, 28)), None
                span = (self.horizon - self.start).days
                if k and rng.random() < s["dealers"]["new_share"]:
                    opened = self.start + timedelta(days=rng.randrange(span))
                elif k and rng.random() < s["dealers"]["closed_share"]:
                    closed = self.start + timedelta(days=rng.randrange(200, span))
                name = f"{city} {rng.choice(s['dealer_words'])} {rng.choice(s['dealer_suffixes'])}"
                out.append({"dealer_id": len(out) + 1, "dealer_name": name, "country": country, "city": city, "region": region, "dealer_tier": tier, "opened": opened, "closed": closed, "slow": False})
        steady = [d for d in out if d["closed"] is None and d["opened"] < self.start and d["dealer_tier"] != "Satellite"]
        for d in rng.sample(steady, min(s["patterns"]["p4"]["count"], len(steady) // 4)):
            d["slow"] = True
        return out

    def dealer_slots(self, region: str) -> list[int]:
        """SLOTS dealers of a region, each as often as its tier's weight asks for."""
        own = [d for d in self.dealers if d["region"] == region]
        weights = [self.s["dealers"]["tiers"][d["dealer_tier"]][1] for d in own]
        total, out, reached = sum(weights), [], 0.0
        for d, w in zip(own, weights, strict=True):
            reached += w
            out += [d["dealer_id"]] * (round(SLOTS * reached / total) - len(out))
        return out

    def anchor(self, region: str) -> int:
        return next(d["dealer_id"] for d in self.dealers if d["region"] == region)

    @cached_property
    def campaigns(self) -> list[dict]:
        p, o = self.s["patterns"]["p1"], self.s["recalls"]["other"]
        brakes = {"recall_id": 1, "name": p["name"], "part": self.parts[p["part"]], "announced": self.defect_window[1] + timedelta(days=p["recall_after"]), "remedy": p["remedy"]}
        other = {"recall_id": 2, "name": o["name"], "part": self.parts[o["part"]], "announced": self.at(o["announced"]), "remedy": o["remedy"], "model": o["model"], "window": tuple(self.at(x) for x in o["window"])}
        return [brakes, other]
