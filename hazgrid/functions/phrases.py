"""What free texts of alerts say, in several languages: column expressions over folded text, by tables in which the first rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazgrid.functions.families import alert_family

# Letters and what they fold to; words of vehicles with their kind, colours, brands, words of persons and their
# clothes, and how many characters around a word belong to it.
FOLDED = ("áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")
VEHICLES = (
    ("pickup truck", "truck"), ("pickup", "truck"), ("truck", "truck"), ("suv", "suv"), ("sport utility", "suv"), ("minivan", "van"), ("van", "van"), ("sedan", "sedan"), ("coupe", "sedan"),
    ("hatchback", "sedan"), ("motorcycle", "motorcycle"), ("bus", "bus"), ("car", "sedan"),
)
COLORS = ("red", "blue", "green", "black", "white", "silver", "gray", "grey", "yellow", "orange", "purple", "brown", "tan", "gold", "maroon", "beige", "pink")
BRANDS = (
    "Toyota", "Ford", "Chevrolet", "Chevy", "Honda", "Nissan", "Dodge", "Ram", "GMC", "Jeep", "Hyundai", "Kia", "Subaru", "Mazda", "Tesla", "Volkswagen", "BMW", "Mercedes", "Audi", "Lexus", "Buick",
    "Cadillac", "Chrysler", "Volvo", "Acura", "Infiniti", "Lincoln", "Mitsubishi", "Pontiac", "Saturn", "Freightliner", "Peterbilt", "Kenworth",
)
ENTITY_EVENTS = ("amber", "child abduction", "blue alert", "silver alert", "endangered", "missing", "law enforcement", "civil emergency")
CHILD_WORDS = ("child", "boy", "girl", "infant", "toddler", "juvenile", "-year-old", "year old")
ADULT_WORDS = ("man", "woman", "male", "female", "adult", "suspect")
CLOTHES = ("wearing", "shirt", "jacket", "hoodie", "dress", "pants", "clothing", "hair")
AROUND = 60
# Words of an event, and the name that the risk rules know it by, for severe ones and for others; null keeps the
# event's own. Rain is told apart by its amount.
RISK_RULES = (
    (("ciclon", "huracan", "tormenta tropical", "depresion tropical", "tropical"), "Tropical Storm Warning", "Tropical Storm Watch"),
    (("small craft", "seas", "marine", "oleaje", "mar de fondo", "marejada", "surf"), None, None),
    (("inunda", "riverine", "crecida", "desbordamiento"), "Flood Warning", "Flood Advisory"),
    (("lluvia", "rain"), "Flood Warning", "rain"),
    (("nevada", "nieve", "aguanieve"), "Winter Weather Advisory", "Winter Weather Advisory"),
    (("frente frio", "frio", "helada"), "Cold Weather Advisory", "Cold Weather Advisory"),
    (("calor", "hot spell", "hot weather"), "Heat Advisory", "Heat Advisory"),
    (("viento", "gust"), "Wind Advisory", "Wind Advisory"),
    (("tormenta", "electrica", "granizo", "adverse weather"), "Severe Thunderstorm Warning", "Severe Thunderstorm Watch"),
    (("niebla", "neblina"), "Dense Fog Advisory", "Dense Fog Advisory"),
)
# Words of rain and of heavy rain, words that may not stand between them, and the least millimetres of a flood.
RAIN, HEAVY = r"(?:lluvias?|precipitacion(?:es)?|chubascos?|aguaceros?)", r"(?:muy fuertes?|intensas?|torrencial(?:es)?|extraordinarias?)"
BETWEEN = r"(?!sin\b|vientos?\b|rachas?\b|oleaje\b|olas\b|mar\b)"
AMOUNT = r"(\d+(?:[.,]\d+)?)(?:\s*(?:a|to|-|–)\s*\d+(?:[.,]\d+)?)?\s*(?:mm|milimetros|millimeters|millimetres)\b"
FLOOD_MILLIMETRES = 50.0
# Words of a gentle move, and those after which an instruction says where it leads, in this order.
GENTLE = ("slight", "bear ", "keep ", "stay ")
LEADS = (" onto ", " on to ", " toward ", " towards ", " to stay on ")


def folded(text: Column) -> Column:
    """In lower case, without accents; letters with combining marks lose them."""
    return F.lower(F.translate(F.regexp_replace(text, r"[̀-ͯ]", ""), *FOLDED))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _first(text: Column, words: tuple[str, ...], answers: tuple | None = None) -> Column:
    """struct(word, answer) of the first of ``words`` that ``text`` holds, null without one."""
    table = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(a).alias("answer")) for w, a in zip(words, answers or words, strict=True)))
    return F.get(F.filter(table, lambda row: F.contains(text, row["word"])), F.lit(0))


def _around(text: Column, word: Column) -> Column:
    """The characters around the first occurrence of ``word``, null without one."""
    at = F.call_function("instr", text, word)
    return F.when(at > 0, F.substr(text, F.greatest(at - AROUND, F.lit(1)), at - F.greatest(at - AROUND, F.lit(1)) + F.length(word) + AROUND))


def describes_entity(event: Column) -> Column:
    return _any(F.lower(event), ENTITY_EVENTS)


def vehicle(text: Column) -> Column:
    """struct(kind, color, brand) of the first kind of vehicle in the table that a text names, with the first colour and brand of
    theirs near the word; null without a vehicle."""
    words, kinds = zip(*VEHICLES, strict=True)
    brands = tuple("Chevrolet" if b == "Chevy" else b for b in BRANDS)

    def described(kind: Column, near: Column) -> Column:
        return F.struct(kind.alias("kind"), _first(near, COLORS)["answer"].alias("color"), _first(near, tuple(b.lower() for b in BRANDS), brands)["answer"].alias("brand"))

    def found(lower: Column) -> Column:
        return _once(_first(lower, words, kinds), lambda hit: F.when(hit["word"].isNotNull(), _once(_around(lower, hit["word"]), lambda near: described(hit["answer"], near))))

    return _once(F.lower(text), found)


def person(text: Column) -> Column:
    """struct(child, color) of a person that a text names: the colour near the first word of clothes that has one. Null without one."""

    def found(lower: Column) -> Column:
        colors = F.array_compact(F.transform(F.array(*map(F.lit, CLOTHES)), lambda word: _once(_around(lower, word), lambda near: _first(near, COLORS)["answer"])))
        child = _any(lower, CHILD_WORDS)
        return F.when(child | _any(lower, ADULT_WORDS), F.struct(child.alias("child"), F.get(colors, F.lit(0)).alias("color")))

    return _once(F.lower(text), found)


def heavy_rain(text: Column) -> Column:
    """Whether folded ``text`` puts its rain at a flood's: by words, or by an amount of 50 millimetres or more."""
    said = rf"(?<!\bsin\s)\b{RAIN}(?:\s+{BETWEEN}[\p{{L}}\p{{M}}\p{{N}}_]+){{0,4}}?\s+{HEAVY}\b|(?<!\bsin\s)\b{HEAVY}\s+{RAIN}"
    amounts = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit(".")).cast("double"))
    return _any(text, ("very heavy rain", "torrential", "extreme rain")) | text.rlike(said) | F.exists(amounts, lambda a: a >= FLOOD_MILLIMETRES)


def risk_words(event: Column, severity: Column, detail: Column) -> Column:
    """A service's own name of an alert in the words that the risk rules read; events that they know already, and those that no
    rule names, stay."""
    text = lambda x: F.lit(x).cast("string")
    rules = F.array(*(F.struct(F.array(*map(F.lit, words)).alias("words"), text(severe).alias("severe"), text(other).alias("other")) for words, severe, other in RISK_RULES))
    strong = F.lower(severity).isin("severe", "extreme")

    def named(rule: Column) -> Column:
        rain = F.when(heavy_rain(folded(F.concat_ws(" ", event, detail))), "Flood Advisory").otherwise("Rain Advisory")
        return F.coalesce(F.when(strong, rule["severe"]).when(rule["other"] == "rain", rain).otherwise(rule["other"]), event)

    rule = lambda e: _once(F.get(F.filter(rules, lambda r: F.exists(r["words"], lambda w: F.contains(e, w))), F.lit(0)), named)
    return F.when((event == "") | alert_family(event).isNotNull(), event).otherwise(_once(folded(event), rule))


def side(instruction: Column) -> Column:
    """left or right, whichever an instruction names first before it says where it leads; null for none."""

    def turned(way: Column) -> Column:
        left, right = F.instr(way, "left"), F.instr(way, "right")
        return F.when((left > 0) & ((right == 0) | (left < right)), "left").when(right > 0, "right")

    def way(lower: Column) -> Column:
        lead = F.get(F.filter(F.array(*map(F.lit, LEADS)), lambda w: F.contains(lower, w)), F.lit(0))
        return _once(F.when(lead.isNotNull(), F.call_function("substring_index", lower, lead, F.lit(1))).otherwise(lower), turned)

    return _once(F.lower(instruction), way)


def maneuver(instruction: Column) -> Column:
    """The sign of an instruction, by the first rule that fits; straight ahead where none does."""

    def sign(x: Column) -> Column:
        s, to = x["text"], x["side"]
        turn = F.when(to == "left", "turn left").when(to == "right", "turn right")
        return (
            F.when(_any(s, ("arrive", "you have arrived")), "arrive").when(_any(s, ("u-turn", "make a u turn")), "u-turn").when(_any(s, ("roundabout", "traffic circle", "rotary")), "roundabout")
            .when(_any(s, GENTLE), F.when(to == "left", "up left").when(to == "right", "up right").otherwise("up")).when(_any(s, ("merge",)), "merge")
            .when(_any(s, ("exit", "ramp", "sharp")), F.coalesce(turn, F.lit("turn right"))).when(_any(s, ("turn", "left", "right")), F.coalesce(turn, F.lit("up"))).otherwise("up")
        )

    return F.when(instruction.isNotNull(), _once(F.struct(F.lower(instruction).alias("text"), side(instruction).alias("side")), sign)).otherwise("up")
