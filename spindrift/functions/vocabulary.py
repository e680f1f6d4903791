"""Fixed values of the search domain: word lists, maps, weights and patterns, as text."""

# Stop words.
STOP_WORDS = "в во для до и из или к на о об от по под при с со у товар товары".split()

# The Latin keyboard layout and the Cyrillic letters on the same keys.
LATIN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`"
CYRILLIC_KEYS = "йцукенгшщзхъфывапролджэячсмитьбюё"

# Letters that spelling signatures do not tell apart.
SIGNATURE_FROM, SIGNATURE_TO = "ёэйъщф", "ееиьшв"

# Units and their full names.
UNIT_NAMES = {
    "гм2": "грамм на квадратный метр", "гр": "грамм", "гр.": "грамм", "кг": "килограмм", "л": "литр", "л.": "литр", "м": "метр", "м.": "метр",
    "мл": "миллилитр", "мм": "миллиметр", "см": "сантиметр", "шт": "штука", "шт.": "штука", "уп": "упаковка", "уп.": "упаковка", "упак": "упаковка",
    "лист": "лист", "листа": "лист", "листов": "лист", "листы": "лист", "пач": "пачка", "пач.": "пачка", "пачка": "пачка", "пачки": "пачка", "пачек": "пачка",
}

# Abbreviations and what they stand for.
EXPANSIONS = {
    "мфу": ["многофункциональное устройство", "принтер", "сканер", "копир"],
    "пк": ["персональный компьютер", "компьютер"],
    "ноут": ["ноутбук"],
    "оргтехника": ["офисная техника", "организационная техника"],
    "канцтовары": ["канцелярские товары", "офисные принадлежности", "канцелярия"],
    "канцелярия": ["канцтовары", "канцелярские товары", "офисные принадлежности"],
    "канцтовар": ["канцтовары", "канцелярские товары"],
    "хозтовары": ["хозяйственные товары"],
    "ибп": ["источник бесперебойного питания", "ups"],
    "озу": ["оперативная память", "ram"],
    "ссд": ["ssd", "твердотельный накопитель"],
    "жк": ["жидкокристаллический"],
    "лкм": ["лакокрасочные материалы"],
    "гсм": ["горюче смазочные материалы"],
    "сиз": ["средства индивидуальной защиты"],
}
LONGEST_TOKEN = 64

# Patterns of two words, and the phrase that replaces them.
PHRASES = [
    (r"\bканц[\w-]*\s+товар[\w-]*\b", "канцтовары"),
    (r"\bканцелярск[\w-]*\s+товар[\w-]*\b", "канцтовары"),
    (r"\bорг[\w-]*\s+техник[\w-]*\b", "оргтехника"),
    (r"\bхоз[\w-]*\s+товар[\w-]*\b", "хозтовары"),
    (r"\bрабоч[\w-]*\s+станц[\w-]*\b", "рабочая станция"),
    (r"\bперсональн[\w-]*\s+компьютер[\w-]*\b", "персональный компьютер"),
]

# Word endings and their replacements, first match counts.
SUFFIXES = [
    ("иями", "ия"), ("ями", "я"), ("ами", "а"), ("ого", "ый"), ("его", "ий"), ("ому", "ый"), ("ему", "ий"), ("ыми", "ый"), ("ими", "ий"), ("ых", "ый"),
    ("их", "ий"), ("ее", "ий"), ("ие", "ий"), ("ые", "ый"), ("ое", "ый"), ("ая", "ый"), ("яя", "ий"), ("ую", "ый"), ("юю", "ий"), ("ов", ""), ("ев", ""),
    ("ей", ""), ("ам", ""), ("ям", ""), ("ах", ""), ("ях", ""), ("ом", ""), ("ем", ""), ("ы", ""), ("а", ""), ("я", ""), ("е", ""), ("о", ""), ("у", ""), ("ю", ""),
]
ENDINGS_TO_A = "гкхжчшщ"

# Latin tokens that are never a layout mistake, and Cyrillic abbreviations without a lemma.
LATIN_KEPT = "amd api cpu dell epson gpu hdd hdmi hp intel ios it lan lenovo linux ram ssd usb wifi xerox".split()
ABBREVIATIONS = "гсм жк ибп лкм мфу озу пк сиз ссд".split()

# Terms of structured queries.
SIZES = "xs s m l xl xxl xxxl a0 a1 a2 a3 a4 a5 a6".split()
COLORS = "белый белая белое черный черная черное синий синяя синее голубой зеленый красный серый серебристый желтый оранжевый фиолетовый розовый прозрачный".split()
MATERIALS = "нитрил нитриловый нитриловые латекс латексный латексные винил виниловый виниловые бумажный бумажные пластик пластиковый пластиковые металл металлический металлические".split()
PACKAGES = "упаковка пачка комплект набор коробка рулон лист штука".split()
UNITS = "грамм килограмм литр миллилитр метр миллиметр сантиметр штука упаковка лист пачка".split()
GENERIC_LATIN = "api cpu gpu hdd hdmi ios it lan linux ram ssd usb wifi".split()
MODEL_PATTERN = "^(?=.*[a-zа-я])(?=.*[0-9])[a-zа-я0-9-]+$"
ATTACHED_PATTERN = "^([0-9]+(?:[.,][0-9]+)?)([a-zа-я]+)$"
DIMENSION_PATTERN = "^[0-9]+(?:[.,][0-9]+)?(?:х[0-9]+(?:[.,][0-9]+)?){1,2}$"
PAPER_PATTERN = "^a[0-6]$"
BRAND_PATTERN = "^[a-z]{2,}$"
CODE_PATTERN = "^(?:гост|ту|iso|din|en|окпд2|окп|арт|артикул)[a-zа-я0-9-]*$"
NUMBER_PATTERN = "^(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$"

# Weights of fields and channels, and constants of the scores.
FIELD_WEIGHTS = {"title": 2.4, "attributes": 1.55, "category": 1.35, "description": 0.7, "supplier": 0.45}
LEMMA_WEIGHTS = {"title": 2.15, "attributes": 1.45, "category": 1.25, "description": 0.65, "supplier": 0.35}
CHANNEL_WEIGHTS = {"exact_structured": 1.45, "attribute": 1.2, "bm25": 1.2, "morphology": 1.0, "fuzzy": 0.9, "synonym_bm25": 0.8, "semantic": 0.8}
CHANNEL_REASONS = {"exact_structured": "retrieval_exact", "attribute": "retrieval_attribute", "bm25": "retrieval_bm25", "morphology": "retrieval_morphology", "fuzzy": "retrieval_fuzzy", "synonym_bm25": "retrieval_synonym", "semantic": "retrieval_semantic"}
BM25_K1, BM25_B, RRF_K = 1.45, 0.72, 60

# Legal forms and empty words of suppliers' names.
NAME_STOP_WORDS = ["ооо", "ао", "оао", "зао", "ип", "fgup", "фгуп", "group", "trade"]

# Attributes that name the supplier, best first, and the name of a supplier that isn't known.
SUPPLIER_KEYS = ["Производитель", "Производитель медицинского изделия", "Производитель товара", "Изготовитель", "Торговая марка", "Бренд", "Марка"]
NO_SUPPLIER = "Поставщик не указан"

# Event types that are recorded.
EVENT_TYPES = [
    "search_submitted", "search_results_rendered", "search_impression", "suggestion_clicked", "result_clicked", "result_opened", "result_opened_new_tab",
    "product_view_started", "product_view_ended", "item_copy", "favorite_added", "favorite_removed", "comparison_added", "comparison_removed",
    "cart_added", "cart_removed", "cart_quantity_changed", "filter_applied", "filter_removed", "filters_cleared", "sort_changed",
    "purchase_completed", "quick_back", "scroll_depth_changed", "search_refined", "search_abandoned", "purchase_intent", "irrelevant_marked",
]

# Event types shown as activity, by the filter they belong to.
ACTIVITY_FILTERS = {
    "search": ["search_submitted", "search_results_rendered", "search_refined", "suggestion_clicked", "result_clicked", "result_opened", "result_opened_new_tab", "filter_applied", "filter_removed", "filters_cleared", "sort_changed"],
    "shortlist": ["favorite_added", "favorite_removed", "comparison_added", "comparison_removed"],
    "cart": ["cart_added", "cart_removed", "cart_quantity_changed", "purchase_intent"],
    "purchase": ["purchase_completed"],
    "feedback": ["item_copy", "irrelevant_marked"],
}

# Activity types whose title is made of words alone, of words and the item, or of words and the quoted query.
PLAIN_TITLES = {
    "search_refined": "Запрос уточнен",
    "filter_applied": "Применен фильтр",
    "filter_removed": "Фильтр снят",
    "filters_cleared": "Фильтры очищены",
    "sort_changed": "Изменен режим сортировки",
    "purchase_intent": "Подготовлен закупочный черновик",
}
ITEM_TITLES = {
    "result_clicked": "Открыт результат",
    "result_opened": "Карточка просмотрена",
    "result_opened_new_tab": "Карточка открыта в новой вкладке",
    "item_copy": "Скопирован фрагмент карточки",
    "favorite_added": "Добавлено в избранное",
    "favorite_removed": "Убрано из избранного",
    "comparison_added": "Добавлено в сравнение",
    "comparison_removed": "Убрано из сравнения",
    "cart_added": "Добавлено в корзину",
    "cart_removed": "Удалено из корзины",
    "cart_quantity_changed": "Изменено количество в корзине",
    "purchase_completed": "Оформлена закупка",
    "irrelevant_marked": "Позиция отмечена как нерелевантная",
}
QUERY_TITLES = {
    "search_submitted": "Новый запрос",
    "search_results_rendered": "Получена выдача по запросу",
    "suggestion_clicked": "Выбрана подсказка",
}
NO_QUERY, NO_ITEM = "без запроса", "позиция"

# Event types that make an item viewed, and shortlisted.
VIEWED_TYPES = ["result_opened", "product_view_started", "product_view_ended", "item_copy", "favorite_added", "comparison_added", "cart_added", "quick_back"]
SHORTLIST_TYPES = ["favorite_added", "comparison_added", "cart_added", "purchase_intent"]

# How reasons are shown.
REASON_LABELS = {
    "exact_title_match": "Точное совпадение",
    "prefix_title_match": "Совпадение по началу названия",
    "partial_title_match": "Совпадение по названию",
    "fuzzy_title_match": "Учтена опечатка или близкая формулировка",
    "description_match": "Совпадение по описанию",
    "token_match": "Совпадение по ключевым словам",
    "matches_purchase_history": "Похоже на историю закупок",
    "recent_interaction": "Недавний интерес",
    "popular_supplier": "Часто выбираемый поставщик",
    "popular_in_organization": "Популярно в организации",
}
RELATED_LABELS = {"same_category": "Та же категория", "same_supplier": "Тот же поставщик", "title_overlap": "Похожие формулировки", "attribute_overlap": "Совпадают атрибуты"}
GROUP_LABELS = {"history": "История", "categories": "Категории", "products": "Товары"}

# Thresholds and sizes of searches.
FULL_TEXT_LEAST, TRIGRAM_LEAST, TRIGRAM_MATCH, TRIGRAM_WEIGHT = 0.01, 0.08, 0.3, 1.2
POOL_FACTOR, POOL_LEAST, POOL_MOST, EXPANDED_FACTOR, EXPANDED_LEAST = 8, 300, 1200, 2, 60


def pool_size(limit: int) -> int:
    """Documents of a shortlist."""
    return min(POOL_MOST, max(POOL_FACTOR * limit, POOL_LEAST))


def expanded_limit(limit: int) -> int:
    """Hits of a channel."""
    return max(EXPANDED_FACTOR * limit, EXPANDED_LEAST)
