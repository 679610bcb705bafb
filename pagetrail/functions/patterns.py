"""Fixed values of the text and number functions."""

# Spaces that group thousands (plain, no-break, narrow no-break, thin, figure) and, for cells, word joiner.
GROUP_SPACES = "\u0020\u00a0\u202f\u2009\u2007"
CELL_SPACES = "\u00a0\u202f\u2009\u2007\u2060\u0020"
TEXT_SPACES = "\u00a0\u202f\u2009\u2007\u2060"
ANSWER_SPACES = "\u0020\u00a0\u202f\u2009"

# Signs that stand for minus, cells that mean "no value", and footnote marks after a number.
LEADING_MINUS = "\u2212\u2013\u2014\u002d"
CELL_DASHES = "\u2212\u2013\u2014\u2012"
EMPTY_TOKENS = ["", "-", "–", "—", "н/д", "нд", "n/a", "na", "..."]
FOOTNOTES = r"[*\x{2020}\x{2021}\x{b9}\x{b2}\x{b3}\x{2070}-\x{209f}]+$"

# Unit patterns, tried in this order.
UNIT_PATTERNS = [
    ("млрд", "млрд_руб"),
    ("млн", "млн_руб"),
    ("тыс", "тыс_руб"),
    ("%|проц", "%"),
    (r"(^|[^\p{L}\p{N}_])шт($|[^\p{L}\p{N}_])|штук", "шт"),
    (r"п\.\s*п\.|процентн[\p{L}\p{N}_]+ пункт", "п.п."),
]

# Spellings of units.
UNIT_NAMES = {
    "млрд руб": "млрд_руб", "млрд рублей": "млрд_руб", "млрд_руб": "млрд_руб",
    "млн руб": "млн_руб", "млн рублей": "млн_руб", "млн_руб": "млн_руб",
    "руб": "руб", "рублей": "руб", "%": "%", "п.п.": "п.п.", "пп": "п.п.",
    "шт": "шт", "штук": "шт", "млн": "млн", "млрд": "млрд",
}
MONEY_UNITS = ["млрд_руб", "млн_руб", "руб"]

# Period aliases.
PERIOD_NAMES = {"2024_итоговый": "2024fin", "1п2024": "1h2024", "1п2025": "1h2025"}

# Canonical metrics, first hit wins.
CANONICAL_METRICS = [
    (r"скорр\w*\s+показател\w*\s+ebitda|скорр\w*\s+ebitda|скорректированн\w+\s+ebitda", "ebitda_adj"),
    (r"рентабельност\w*\s+по\s+скорр\w*\s*(показател\w*)?\s*ebitda|рентабельност\w*\s+скорр\w*\s*(показател\w*)?\s*ebitda", "ebitda_margin"),
    (r"скорр\w*\s+чист\w+\s+прибыл\w*", "net_profit_adj"),
    (r"чист\w+\s+прибыл\w*", "net_profit"),
    (r"операционн\w+\s+прибыл\w*", "op_profit"),
    (r"операционн\w+\s+расход\w*", "op_cost"),
    (r"валов\w+\s+оборот|gtv", "gtv"),
    (r"capex\s*,?\s*%\s*от\s+выручки|capex\s+%", "capex_pct"),
    (r"\bcapex\b", "capex"),
    (r"выручк\w*", "revenue"),
    (r"дол\w+\s+в\s+выручке|распределени\w+\s+выручк\w*", "revenue_share"),
    (r"подписчик\w*", "subscribers"),
    (r"\bmau\b", "mau"),
    (r"дол\w+\s+поиск\w*|дол\w+\s+яндекса\s+на\s+российск\w+\s+поисков\w+", "search_share"),
    (r"дивиденд\w*\s+на\s+одну\s+акци\w*|дивиденд\w*\s+на\s+акци\w*", "div_per_share"),
    (r"обща\w+\s+сумм\w+\s+дивиденд\w*", "div_total"),
    (r"коррекци\w+\s+на\s+межсегментн\w+", "intersegment"),
]
CHANGE_WORDS = r"изменени\w*|прирост|рост\b|г/г|yoy"

# Numbers, years, page references and tokens in running text.
ANSWER_NUMBER = r"-?[0-9]{1,3}(?:[\x{20}\x{a0}\x{202f}\x{2009}][0-9]{3})+(?:[.,][0-9]+)?|-?[0-9]+(?:[.,][0-9]+)?"
YEAR = r"^(19|20)[0-9]{2}$"
PAGE_REFERENCE = r"стр\.?\s*[0-9]{1,3}(?:\s*[-\x{2013}\x{2014}]\s*[0-9]{1,3})?"
CITED_PAGE = r"стр\.?\s*([0-9]{1,3})"
TOKEN = r"[\p{L}\p{N}_-]+"

# Requests for advice, and verdicts in answers.
ADVICE = [
    r"стоит\s+ли\s+(инвестир|вклад|покуп|брать)",
    r"(инвестиц\w+|покупк\w+)\s+рекоменд",
    r"рекоменду\w*\s+(ли\s+)?(покуп|продав|инвестир)",
    r"(покупать|продавать)\s+(ли\s+)?(акци|бумаг)",
    r"хорош\w+\s+ли\s+(это\s+)?(вложен|инвестиц)",
    r"выгодно\s+ли\s+(вклад|инвестир|покуп)",
    r"should\s+i\s+(invest|buy)",
]
VERDICTS = [
    r"(?<!не )(рекомендую|советую|стоит|следует)\s+(купить|покупать|продать|продавать|инвестировать|вкладывать)",
    r"(?<!не )(покупайте|продавайте|инвестируйте)",
    r"(хорош\w+|отличн\w+|плох\w+)\s+(момент|время)\s+для\s+(покупк|входа|инвестиц)",
    r"(акци\w+|бумаг\w+)\s+(стоит|следует)\s+(купить|покупать|брать)",
    r"однозначно\s+(да|нет|покупать|продавать)",
    r"i\s+(recommend|advise)\s+(buying|to\s+buy)",
]
REFUSALS = ["не приводит", "не раскрыв", "нет данных", "не содержит", "таких данных нет", "не указан", "не приводится", "отсутству"]

# Plausible ranges by unit as (unit, least, most).
VALUE_RANGES = [("млрд_руб", -2000.0, 2000.0), ("млн_руб", -100000.0, 100000.0), ("%", -100.0, 1000.0), ("млн", -1000.0, 1000.0)]
