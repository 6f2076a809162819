"""Weather-code text and the derived values of the weather panel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill.functions.numbers import clamp

# Weather code to condition text, short (12) and full (19) table.
SHORT_CODES = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "foggy",
    51: "light drizzle", 61: "light rain", 63: "moderate rain", 65: "heavy rain", 71: "light snow",
    80: "rain showers", 95: "thunderstorm",
}
FULL_CODES = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "foggy", 48: "icy fog",
    51: "light drizzle", 53: "moderate drizzle", 55: "heavy drizzle", 61: "light rain",
    63: "moderate rain", 65: "heavy rain", 71: "light snow", 73: "moderate snow", 75: "heavy snow",
    80: "rain showers", 85: "snow showers", 95: "thunderstorm", 99: "thunderstorm with hail",
}


def condition_text(code: Column, codes: dict[int, str] = SHORT_CODES) -> Column:
    """Text for a weather code, `unknown` for any other code."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))


def temperature_band(temperature: Column) -> Column:
    return F.when(temperature < 5, "cold").when(temperature < 20, "mild").otherwise("hot")


def temperature_gauge(temperature: Column) -> Column:
    """Position on a -20..40 degree scale in percent."""
    return clamp((temperature.cast("double") + 20) / 60 * 100, 0.0, 100.0)


def humidity_gauge(humidity: Column) -> Column:
    return clamp(humidity.cast("double"), 0.0, 100.0)


def feels_like(temperature: Column) -> Column:
    return temperature - 2


def first_word(condition: Column) -> Column:
    return F.split(condition, " ")[0]
