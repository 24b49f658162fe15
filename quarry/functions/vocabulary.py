"""The ordered alias dictionaries of the catalogue domain. The first alias in this order that a text holds as a
whole word gives the canonical value."""

BRAND = {
    "temper": "Temper",
    "broen": "Broen",
    "also": "ALSO",
    "алсо": "ALSO",
    "marshal": "MARSHAL",
    "маршал": "MARSHAL",
    "бивал": "Бивал",
    "bival": "Бивал",
    "forteca": "FORTECA",
}

CONNECTION = {
    "фланцевое": "фланцевое",
    "фланцевый": "фланцевое",
    "фланец": "фланцевое",
    "flanged": "фланцевое",
    "резьбовое": "резьбовое",
    "резьбовой": "резьбовое",
    "резьба": "резьбовое",
    "threaded": "резьбовое",
    "сварное": "сварное",
    "сварной": "сварное",
    "сварка": "сварное",
    "welded": "сварное",
    "под приварку": "сварное",
    "муфтовое": "муфтовое",
    "муфтовый": "муфтовое",
    "coupling": "муфтовое",
}

MEDIUM = {
    "жидкость": "жидкость",
    "вода": "жидкость",
    "water": "жидкость",
    "газ": "газ",
    "gas": "газ",
    "пар": "пар",
    "steam": "пар",
    "нефть": "нефть",
    "oil": "нефть",
    "нефтепродукты": "нефтепродукты",
}

CONTROL = {
    "ручное": "ручное",
    "manual": "ручное",
    "рукоятка": "ручное",
    "рычаг": "ручное",
    "электропривод": "электропривод",
    "electric": "электропривод",
    "пневмопривод": "пневмопривод",
    "pneumatic": "пневмопривод",
    "редуктор": "редуктор",
    "gear": "редуктор",
}

DIMENSIONS = {"brand": BRAND, "connection": CONNECTION, "medium": MEDIUM, "control": CONTROL}
