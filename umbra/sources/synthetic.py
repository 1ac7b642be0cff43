"""Synthetic personal data, span examples and records, from hashes of row numbers: any number of rows, in parallel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import fixed
from umbra.functions.text import once


def chance(row: Column, salt: str, n: int) -> Column:
    """A number below n that depends on the row and a salt."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", row.cast("string"), F.lit(salt)), 256), 1, 12), 16, 10).cast("long") % F.lit(n)


def pick(row: Column, salt: str, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (chance(row, salt, len(values)) + 1).cast("int"))


def chosen(at: Column, forms: Sequence[Column]) -> Column:
    """The form of this number, from 0; the others aren't computed."""

    def of(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for n, form in enumerate(forms):
            out = F.when(i == n, form).otherwise(out)
        return out

    return once(at, of)


def digits(row: Column, salt: str, size: int) -> Column:
    return F.lpad(chance(row, salt, 10**size).cast("string"), size, "0")


def number(row: Column, salt: str, low: int, high: int) -> Column:
    return (chance(row, salt, high - low + 1) + low).cast("string")


def tw_id(row: Column) -> Column:
    """A letter, 1 or 2, seven digits and a check digit by the weights that generated ids have always had."""
    def of(x: Column) -> Column:
        code = F.ascii(x["letter"])
        total = F.when(code > 74, code - 55).otherwise(code - 64) + x["sex"].cast("int") * 9
        for i in range(7):
            total = total + F.substring(x["body"], i + 1, 1).cast("int") * (8 - i)
        return F.concat(x["letter"], x["sex"], x["body"], ((10 - total % 10) % 10).cast("string"))

    return once(F.struct(pick(row, "letter", list(fixed.ID_LETTERS)).alias("letter"), pick(row, "sex", ["1", "2"]).alias("sex"), digits(row, "id", 7).alias("body")), of)


def phone(row: Column) -> Column:
    head, tail = F.concat(F.lit("09"), number(row, "p1", 10, 99)), number(row, "p2", 100000, 999999)
    return F.when(chance(row, "p3", 2) == 0, F.concat(head, F.lit("-"), F.substring(tail, 1, 3), F.lit("-"), F.substring(tail, 4, 3))).otherwise(F.concat(head, tail))


def address(row: Column) -> Column:
    some = lambda salt, n: chance(row, salt, 10) < n
    lane = F.when(some("a1", 3), F.concat(number(row, "a2", 1, 100), F.lit("巷"), F.when(some("a3", 5), F.concat(number(row, "a4", 1, 20), F.lit("弄"))).otherwise("")))
    floor = F.when(some("a5", 5), F.concat(number(row, "a6", 1, 25), F.lit("樓"), F.when(some("a7", 3), F.concat(F.lit("之"), number(row, "a8", 1, 5))).otherwise("")))
    return F.concat(pick(row, "city", fixed.CITIES), pick(row, "street", fixed.STREETS), pick(row, "kind", fixed.STREET_KINDS), F.coalesce(lane, F.lit("")), number(row, "a9", 1, 100), F.lit("號"), F.coalesce(floor, F.lit("")))


def name(row: Column) -> Column:
    of = lambda x: F.concat(pick(row, "surname", fixed.SURNAMES), x["given"], F.when((chance(row, "two", 10) < 3) & (x["given"] != x["second"]), x["second"]).otherwise(""))
    return once(F.struct(pick(row, "given", fixed.GIVEN_NAMES).alias("given"), pick(row, "second", fixed.GIVEN_NAMES).alias("second")), of)


def medical_record(row: Column) -> Column:
    forms = [
        F.concat(F.substring(pick(row, "hospital", fixed.HOSPITALS), 1, 3), F.lit("-"), number(row, "m1", 100000, 999999)), number(row, "m2", 10000000, 99999999),
        F.concat(F.lit("MR"), pick(row, "m3", ["A", "B", "C"]), number(row, "m4", 10000, 99999)), F.concat(F.lit("病歷號："), number(row, "m5", 1000000000, 9999999999)),
    ]
    return chosen(chance(row, "m6", 4), forms)


def card(row: Column) -> Column:
    size = lambda prefix: F.when(F.length(prefix) == 1, 16).otherwise(15) - F.length(prefix)
    of = lambda prefix: F.concat(prefix, F.substring(F.concat(digits(row, "c1", 10), digits(row, "c2", 10)), F.lit(1), size(prefix)))
    return once(pick(row, "issuer", fixed.CARD_PREFIXES), of)


def birth_date(row: Column, year: int = 2025) -> Column:
    """A date from 18 to 90 years before `year`, in one of three forms."""
    first = F.make_date(F.lit(year) - (chance(row, "age", 73) + 18).cast("int"), (chance(row, "month", 12) + 1).cast("int"), F.lit(1))
    day = lambda first: F.date_add(first, (chance(row, "day", 31) % F.dayofmonth(F.last_day(first))).cast("int"))
    forms = lambda day: [F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日")), F.date_format(day, "yyyy-MM-dd"), F.concat(F.dayofmonth(day), F.lit("/"), F.month(day), F.lit("/"), F.date_format(day, "yy"))]
    return once(once(first, day), lambda day: chosen(chance(row, "form", 3), forms(day)))


def email(row: Column) -> Column:
    tail = chosen(chance(row, "e4", 4), [F.lit(""), number(row, "e1", 1, 99), number(row, "e2", 10, 99), F.concat(F.lit("."), number(row, "e3", 1970, 2023))])
    return F.lower(F.concat(name(row), tail, F.lit("@"), pick(row, "domain", fixed.DOMAINS)))


def passport(row: Column) -> Column:
    return F.concat(pick(row, "pp", list("ABCDEFGH")), number(row, "pn", 1000000, 9999999))


def plate(row: Column) -> Column:
    letters = F.concat(*[pick(row, f"l{i}", list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for i in range(3)])
    return F.when(chance(row, "l3", 2) == 0, F.concat(letters, F.lit("-"), digits(row, "l4", 3))).otherwise(F.concat(digits(row, "l4", 3), F.lit("-"), letters))


def insurance(row: Column) -> Column:
    return number(row, "ins", 10000000000, 99999999999)


KINDS = {
    "TW_ID": tw_id, "PHONE": phone, "ADDRESS": address, "NAME": name, "MEDICAL_RECORD": medical_record, "DATE_OF_BIRTH": birth_date, "EMAIL": email, "CREDIT_CARD": card, "PASSPORT": passport,
    "LICENSE_PLATE": plate, "HEALTH_INSURANCE": insurance,
}


def values(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, type, value, context): a value of a random type for each row."""
    typed = rows.select(key, pick(F.col(key), "type", list(KINDS)).alias("type"))
    of = lambda x: by_name(x["type"], {k: f(x["row"]) for k, f in KINDS.items()})
    context = once(F.col(key), lambda row: paragraph(row))
    return typed.withColumn("value", once(F.struct("type", F.col(key).alias("row")), of)).withColumn("context", context)


def by_name(kind: Column, forms: dict[str, Column]) -> Column:
    """The form of this name; the others aren't computed."""
    out = F.lit(None).cast("string")
    for k, form in forms.items():
        out = F.when(kind == k, form).otherwise(out)
    return out


def paragraph(row: Column, sentences: int = 3) -> Column:
    """Sentences with their slots for personal data filled; slots of no type stay as they are."""
    makers = {**KINDS, "DATE": birth_date}

    def sentence(own: Column) -> Column:
        return chosen(chance(own, "template", len(fixed.PARAGRAPHS)), [filled(p, own) for p in fixed.PARAGRAPHS])

    def filled(template: str, own: Column) -> Column:
        parts = re.split("|".join(rf"(?={{{k}}})|(?<={{{k}}})" for k in makers), template)
        return F.concat(*[makers[p[1:-1]](own) if p[1:-1] in makers and p == f"{{{p[1:-1]}}}" else F.lit(p) for p in parts if p])

    each = F.array(*[F.concat_ws(":", row.cast("string"), F.lit(str(i))) for i in range(sentences)])
    return F.array_join(F.transform(each, sentence), "")


def span_examples(rows: DataFrame, language: str = "zh", key: str = "doc_id") -> DataFrame:
    """key, text and entities: a record with a name, phone, e-mail address, address and id in each row, with their spans."""
    row = F.col(key)
    user = F.concat(F.lit("user"), row.cast("string"), digits(row, "user", 4), F.lit("@example.com"))
    if language == "zh":
        call, ident = F.concat(F.lit("09"), digits(row, "phone", 8)), F.concat(pick(row, "letter", list(fixed.ID_LETTERS)), digits(row, "id", 9))
        end = "。\n"
    else:
        call = F.concat(F.lit("+1-555-"), number(row, "ph1", 100, 999), F.lit("-"), number(row, "ph2", 1000, 9999))
        ident = F.concat(number(row, "i1", 100, 999), F.lit("-"), number(row, "i2", 10, 99), F.lit("-"), number(row, "i3", 1000, 9999))
        end = ".\n"
    labels = fixed.LABELS[language]
    parts = [(labels[0], "NAME", pick(row, "name", fixed.NAMES[language]), end), (labels[1], "PHONE", call, ", "), ("", "EMAIL", user, end), (labels[2], "ADDRESS", pick(row, "address", fixed.ADDRESSES[language]), ".\n"), (labels[3], "ID", ident, end)]
    out, texts, at = [], [], F.lit(0)
    for before, kind, value, after in parts:
        start = at + F.lit(len(before))
        stop = start + F.length(value)
        out.append(F.struct(start.alias("start"), stop.alias("end"), F.lit(kind).alias("type"), value.alias("text")))
        texts += [F.lit(before), value, F.lit(after)]
        at = stop + F.lit(len(after))
    return rows.select(key, F.concat(*texts).alias("text"), F.array(*out).alias("entities"))


def documents(rows: DataFrame, key: str = "id", day: str = "2025-01-01") -> DataFrame:
    """(key, kind, text): a medical record, an account statement, a contract, a report or a paragraph for each row."""
    kinds = ["medical_record", "financial", "contract", "report", "paragraph"]
    typed = rows.select(key, pick(F.col(key), "document", kinds).alias("kind"))
    return typed.withColumn("text", once(F.struct("kind", F.col(key).alias("row")), lambda x: by_name(x["kind"], _texts(x["row"], day))))


def _texts(row: Column, day: str) -> dict[str, Column]:
    """The text of each kind of document."""
    when = lambda salt, days: F.date_format(F.date_sub(F.to_date(F.lit(day)), (chance(row, salt, days) + 1).cast("int")), "yyyy-MM-dd")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    who = [line("姓名", name(row)), line("身分證字號", tw_id(row)), line("電話", phone(row)), line("地址", address(row))]
    record = [F.lit("====== 醫療記錄 ======"), line("病歷號", medical_record(row)), line("日期", when("visit", 365)), line("醫院", F.concat(pick(row, "h", fixed.HOSPITALS), F.lit(" - "), pick(row, "s", fixed.SPECIALTIES))), *who, line("出生日期", birth_date(row)), paragraph(row, 2)]
    entry = lambda i: F.concat_ws(" | ", when(f"t{i}", 30), pick(row, f"shop{i}", ["超市", "餐廳", "加油站"]), F.concat(F.lit("NT$"), number(row, f"sum{i}", 100, 10000)))
    statement = [F.lit("====== 帳戶對帳單 ======"), *who, line("電子郵件", email(row)), line("帳戶號碼", digits(row, "account", 14)), line("信用卡號", card(row)), *[entry(i) for i in range(3)]]
    contract = [F.lit("====== 合約書 ======"), line("合約編號", F.concat(F.lit("CN-"), digits(row, "contract", 6))), line("簽約日期", when("signed", 365)), *who, paragraph(row, 2)]
    report = [F.lit("====== 報告 ======"), line("日期", when("report", 90)), line("撰寫人", name(row)), paragraph(row, 4)]
    texts = {"medical_record": record, "financial": statement, "contract": contract, "report": report, "paragraph": [paragraph(row, 10)]}
    return {kind: F.concat_ws("\n", *lines) for kind, lines in texts.items()}


def rows(spark: SparkSession, n: int, key: str = "id") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", key)


def write(values_of: DataFrame, documents_of: DataFrame, folder: str) -> None:
    """Values as CSV (type, value, context) and JSON lines, documents as text by kind."""
    values_of.select("type", "value", "context").write.option("header", True).csv(f"{folder}/csv")
    values_of.write.json(f"{folder}/json")
    documents_of.select("kind", F.col("text").alias("value")).write.partitionBy("kind").text(f"{folder}/txt")
