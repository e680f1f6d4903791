"""Localisation of transliterated and English texts: whole words replaced in order, suppliers' names word by word, categories and roles by a table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import text as T

# Categories, roles and words of suppliers' names, and their translations.
CATEGORIES = {"Transport": "Транспорт", "IT and Equipment": "ИТ и оборудование", "Services": "Услуги", "Office and Supplies": "Офис и снабжение"}
ROLES = {"manager": "менеджер", "customer": "заказчик", "analyst": "аналитик"}
SUPPLIER_WORDS = {
    "ao": "АО", "ooo": "ООО", "zao": "ЗАО", "ip": "ИП", "astra": "Астра", "city": "Сити", "infra": "Инфра", "metro": "Метро", "network": "Сеть", "nova": "Нова", "service": "Сервис",
    "smart": "Смарт", "solutions": "Решения", "supply": "Снабжение", "systems": "Системы", "trade": "Трейд", "transit": "Транзит", "urban": "Урбан", "vector": "Вектор", "group": "Группа", "logistics": "Логистика",
}

# Words and phrases, and their translations, in the order in which they are replaced.
REPLACEMENTS = [
    ("municipal organization", "муниципальная организация"), ("it and equipment", "ИТ и оборудование"), ("office and supplies", "Офис и снабжение"), ("product built around term", "предложение сформировано вокруг термина"),
    ("transport", "транспорт"), ("services", "услуги"), ("dlya ofisov", "для офисов"), ("dlya municipalnyh nuzhd", "для муниципальных нужд"), ("dlya infrastruktury", "для инфраструктуры"), ("dlya zakupok", "для закупок"),
    ("portal postavshikov", "портал поставщиков"), ("service desk", "сервис-деск"), ("it support", "ИТ-поддержка"), ("cleaning service", "клининговая услуга"), ("office supplies", "офисные товары"),
    ("transportnaya logistika", "транспортная логистика"), ("passazhirskie perevozki", "пассажирские перевозки"), ("passazhirskiy transport", "пассажирский транспорт"), ("servernoe oborudovanie", "серверное оборудование"),
    ("mobilnaya rabochaya stanciya", "мобильная рабочая станция"), ("rabochaya stanciya", "рабочая станция"), ("setevoy kommutator", "сетевой коммутатор"), ("setevoe oborudovanie", "сетевое оборудование"),
    ("uborka pomescheniy", "уборка помещений"), ("arenda transporta", "аренда транспорта"), ("tekhnicheskoe obsluzhivanie", "техническое обслуживание"), ("kompleksnaya postavka", "комплексная поставка"),
    ("passazhirskiy", "пассажирский"), ("postavka", "поставка"), ("arenda", "аренда"), ("usluga", "услуга"), ("obsluzhivaniye", "обслуживание"), ("obsluzhivanie", "обслуживание"), ("tehpodderzka", "техподдержка"),
    ("tehpodderzhka", "техподдержка"), ("soprovozhdenie", "сопровождение"), ("autsorsing", "аутсорсинг"), ("ofisnaya mebel", "офисная мебель"), ("kanctovri", "канцтовары"), ("kanctovary", "канцтовары"),
    ("katridzh", "картридж"), ("kartridzh", "картридж"), ("mikroaftobus", "микроавтобус"), ("mikroavtobus", "микроавтобус"), ("komutator", "коммутатор"), ("kommutator", "коммутатор"), ("logstika", "логистика"),
    ("logistika", "логистика"), ("noutbukk", "ноутбук"), ("noutbuk", "ноутбук"), ("printer", "принтер"), ("server", "сервер"), ("bumaga", "бумага"), ("paper", "бумага"), ("toner", "тонер"), ("stationery", "канцтовары"),
    ("minibus", "микроавтобус"), ("switch", "коммутатор"), ("compute node", "вычислительный узел"), ("ekspluataciya", "эксплуатация"), ("servis", "сервис"), ("klinng", "клининг"), ("klining", "клининг"), ("aftobus", "автобус"),
    ("avtobus", "автобус"), ("serer", "сервер"), ("perevozki", "перевозки"), ("s dostavkoy", "с доставкой"), ("pod klyuch", "под ключ"), ("dlya", "для"), ("ofisov", "офисов"), ("municipal", "для муниципальных нужд"),
    ("moskva", "в москве"), ("category", "категория"), ("user", "пользователь"), ("fleet_support", "поддержка автопарка"), ("maintenance", "обслуживание"), ("monthly", "ежемесячное обслуживание"), ("charter", "чартер"),
    ("office", "офис"), ("tower", "башенный"), ("it", "ИТ"), ("supply", "поставка"),
]


def localised(text: Column) -> Column:
    """A text with its words and phrases translated, one after the other, whatever their case; blanks squashed, and a first capital kept. Null stays null."""
    out = text
    for source, target in REPLACEMENTS:
        out = F.regexp_replace(out, rf"(?iU)(?<!\w){re.escape(source)}(?!\w)".replace(r"\ ", " "), target)
    out = T.squash(out)
    first = F.substring(text, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(capital, F.concat(F.upper(F.substring(out, 1, 1)), out.substr(F.lit(2), F.length(out)))).otherwise(out)


def localised_supplier(name: Column) -> Column:
    """A supplier's name word by word: Latin words, numbers at their ends aside, by the table, other words as texts."""

    def word(w: Column) -> Column:
        base, number = F.regexp_extract(w, "^([A-Za-z]+)([0-9]+)?$", 1), F.regexp_extract(w, "^([A-Za-z]+)([0-9]+)?$", 2)
        return F.when(base != "", F.concat(F.coalesce(F.try_element_at(T.literal_map(SUPPLIER_WORDS), F.lower(base)), base), number)).otherwise(localised(w))

    return F.array_join(F.transform(T.split_words(T.squash(name)), word), " ")


def localised_category(name: Column) -> Column:
    return T.mapped(name, CATEGORIES)


def localised_role(role: Column) -> Column:
    return T.mapped(role, ROLES)
