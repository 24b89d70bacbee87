"""Output phrases.  Fixed values: a published row must read the same everywhere."""

NOT_OPERATIONAL = "бізнес не працює (%s)"
EXCLUDED_TYPE = "некомерційний заклад (%s)"
TOO_FEW_REVIEWS = "мало відгуків (%s < %s)"
FOREIGN_ADDRESS = "адреса не в США"
EXCLUDED_HOST = "домен %s — виключена країна"
EXCLUDED_PHONE = "телефон виключеної країни"

NO_SITE_REASON = "сайту нема взагалі"
NO_SITE_MARKER = "сайту нема"
BLOCKED_STATUS = "сайт закритий bot-protection (HTTP %s) — потрібна ручна перевірка"
BLOCKED_STUB = "сайт віддав %s байт без заголовка (HTTP %s) — схоже на заглушку bot-protection, потрібна ручна перевірка"
DEAD_REASON = "сайт не відкривається (%s)"
DEAD_MARKER = "сайт не відкривається"

NO_VIEWPORT = "нема viewport meta — не адаптивний"
NO_HTTPS = "нема HTTPS"
EXPIRED_TLS = "прострочений SSL"
NO_CHARSET = "нема meta charset"
COPYRIGHT = "копірайт %s"
TABLES = "верстка таблицями"
NOT_RESPONSIVE = "не адаптивний"
NO_TITLE_OR_DESCRIPTION = "нема title або description"
NO_H1 = "нема H1"
NO_OPEN_GRAPH = "нема OpenGraph"
NO_FAVICON = "нема favicon"
MODERN_STACK_BONUS = "+25 сучасний стек (%s) — НЕ наш лід"
BUILDER = "конструктор %s"
JQUERY_UNKNOWN = "jQuery (версія невідома)"

EXCLUSION = "виключення: %s"
BLOCKED_TO_MANUAL = "сайт закритий bot-protection — що там насправді, видно лише очима"
MODERN_STACK = "сучасний стек (%s)"
UPSELL = "мова підтверджена (скор %s), але сайт %s/10 — переробляти нема чого, заходити з інших послуг"
UNREAD = "сайт не прочитано (%s)"
WEAK_SIGNAL = "слабкий мовний сигнал (%s)"
NO_SITE_LEAD = "мова підтверджена за назвою (скор %s)"
NOT_A_BUSINESS = "організація або топонім, не комерційний бізнес"

DASH = "—"
STATUSES = (
    "Новий", "В роботі", "Дзвонив, не відповів", "Зацікавлений",
    "Відправив пропозицію", "Угода", "Відмова", "Не наш профіль",
)
NOT_STARTED = "Не опрацьовано"

DIFFICULTY = (
    (28, 1, "односторінковий лендінг"),
    (45, 2, "простий сайт-візитівка"),
    (62, 3, "кілька типів сторінок"),
    (75, 4, "великий сайт з каталогом"),
    (None, 5, "складний проєкт"),
)

FEASIBILITY = (
    (25, "дуже висока"),
    (45, "висока"),
    (60, "середня"),
    (None, "низька — лише ідеальні відгуки"),
)

# Publication tabs: (tab title, buckets that land in it, the score that orders it)
TABS = (
    ("Leads", ("leads",), "site"),
    ("Ліди без сайту", ("no_site_lead",), "owner"),
    ("З хорошим сайтом", ("upsell",), "owner"),
    ("Manual review", ("manual", "pending"), "site"),
    ("NO_SITE", ("no_site",), "site"),
    ("Rejected", ("rejected",), "site"),
)
OLD_TAB_TITLES = {"Свої з сайтом": "З хорошим сайтом"}
SERVICE_TABS = ("Meta", "Аркуш1", "Sheet1")
ORPHAN_MARKER = "⚠ більше не лід"

MACHINE_COLUMNS = (
    "place_id", "Назва компанії", "Тип діяльності", "Тир", "Місто / район", "Сайт",
    "Google Maps", "Телефон", "Email", "Соцмережі", "Оцінка сайту 1-10", "Причини оцінки",
    "Складність розробки", "Мовний скор", "Мова", "Докази мови", "Техстек",
    "PSI моб / деск", "Адаптивний", "HTTPS", "Рейтинг / відгуки", "Скрін + PSI звіт",
    "Опис для продажника",
)
HUMAN_COLUMNS = ("Статус", "Хто веде", "Дата контакту", "Коментар")

LANGUAGE_LABELS = {"uk": "українська", "ru": "російська", "cyr": "кирилиця (не визначено)"}

TYPE_LABELS = {
    "lawyer": "юрист",
    "services": "послуги",
    "medical clinic": "медична клініка",
    "medical center": "медичний центр",
    "grocery store": "продуктовий магазин",
    "consultant": "консалтинг",
    "car repair and maintenance service": "автосервіс",
    "insurance agency": "страхова агенція",
    "doctor": "лікар",
    "real estate agency": "агенція нерухомості",
    "health": "сфера здоров'я",
    "ukrainian restaurant": "український ресторан",
    "eastern european restaurant": "східноєвропейський ресторан",
    "restaurant": "ресторан",
    "shipping service": "служба доставки",
    "wholesaler": "оптова торгівля",
    "travel agency": "турагенція",
    "store": "магазин",
    "roofing contractor": "покрівельні роботи",
    "general contractor": "будівельний підрядник",
    "government office": "державна установа",
    "gift shop": "магазин подарунків",
    "educational institution": "навчальний заклад",
    "book store": "книгарня",
    "banquet hall": "банкетна зала",
    "banking and finance": "фінанси",
    "bakery": "пекарня",
    "dentist": "стоматологія",
    "beauty salon": "салон краси",
    "hair salon": "перукарня",
    "pharmacy": "аптека",
    "moving company": "вантажні перевезення",
    "trucking company": "вантажоперевезення",
    "auto body shop": "кузовний ремонт",
    "accountant": "бухгалтерія",
    "insurance broker": "страховий брокер",
    "construction company": "будівельна компанія",
    "cafe": "кафе",
    "deli": "делікатеси",
    "supermarket": "супермаркет",
}
RETAIL_TYPES = (
    "grocery store", "store", "gift shop", "book store", "bakery", "pharmacy", "wholesaler",
    "supermarket", "deli", "restaurant", "ukrainian restaurant", "eastern european restaurant",
    "cafe",
)

# Words that notes begin with, and that a marker of an unreachable site holds.
BY_HAND, WARNING, DEAD_SITE_WORD = "ручний розбір", "увага", "не відкривається"
SOME_BUSINESS = "заклад"

# Wording of the brief; see operators/brief.py. %s stands for a value.
BRIEF = {
    "between": ", ",
    "place": "%s.",
    "place_at": "%s, %s.",
    "rated": "Рейтинг %s, відгуків: %s.",
    "counted": "Відгуків: %s.",
    "no_site": "Власної сторінки не має.",
    "blocked": "До сайту не пустив захист; його стан невідомий.",
    "not_stored": "Копії сайту немає.",
    "only_measured": "Сторінку бачив лише вимірювач швидкості; подивіться її самі.",
    "dead": "За вказаною адресою ніхто не відповідає.",
    "platform": "Основа: %s.",
    "pages": "Сторінок %s, різних видів %s.",
    "single": "Одна сторінка.",
    "offers": "Має: %s.",
    "shop": "продаж онлайн",
    "shop_module": "модуль продажу, можливо, вимкнений",
    "catalog": "перелік товарів чи страв",
    "forms": "форму запиту",
    "versions": "мовних версій: %s",
    "flaws": "Недоліки: %s.",
    "no_viewport": "незручний на телефоні",
    "no_https": "з'єднання не захищене",
    "tls_expired": "сертифікат минув",
    "mixed_content": "частина вмісту без захисту",
    "flash": "потребує Flash",
    "tables": "розмітка з таблиць",
    "jquery": "стара jQuery %s",
    "old_year": "останній рік унизу сторінки: %s",
    "no_preview": "без опису для пошуку й посилань",
    "slow": "вміст з'являється за %s с",
    "low_score": "мобільна оцінка %s",
    "decided": "Людина вже дивилась: %s.",
    "warned": "Застереження: %s.",
    "open_no_site": "Перша тема: людям з карти нікуди перейти.",
    "open_blocked": "Перша дія: подивитися сайт у браузері.",
    "open_dead": "Перша тема: адреса не працює.",
    "open_phone": "Перша тема: вигляд на телефоні.",
    "open_slow": "Перша тема: %s с очікування.",
    "open_builder": "Перша тема: щомісячна плата за %s.",
    "open_marker": "Перша тема: %s.",
    "open_design": "Перша тема: оновити вигляд.",
}
