"""Small lexical functions of C and C++ text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that qualify a type without changing which one it is.
QUALIFIERS = ["const", "volatile", "static", "inline", "extern", "constexpr", "virtual", "explicit", "friend", "mutable", "register", "struct", "class", "enum", "typename"]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bare_type(declared: Column) -> Column:
    """A declared type without qualifiers, pointers and references; of a template, its first argument."""
    inner = F.coalesce(F.nullif(F.regexp_extract(declared, r"<\s*([^<>,]+?)\s*[,>]", 1), F.lit("")), declared)
    return squeeze(F.translate(F.regexp_replace(inner, r"\b(" + "|".join(QUALIFIERS) + r")\b", " "), "*&", "  "))


def qualifiers(declared: Column) -> Column:
    """The qualifying words of a declaration, sorted."""
    return F.array_sort(F.array_intersect(F.split(squeeze(declared), " "), F.array(*map(F.lit, QUALIFIERS))))


def literal_hint(argument: Column) -> Column:
    """string, char, bool, nullptr, int, float of a literal argument, else null."""
    a = F.trim(argument)
    return (
        F.when(a.rlike(r'^(L|u8|u|U)?"'), "string").when(a.rlike(r"^L?'"), "char").when(a.isin("true", "false", "TRUE", "FALSE"), "bool").when(a.isin("nullptr", "NULL"), "nullptr")
        .when(a.rlike(r"^[-+]?(0[xX][0-9a-fA-F]+|[0-9]+)[uUlL]*$"), "int").when(a.rlike(r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[fFlL]?$"), "float")
    )


def fits_hint(hint: Column, parameter: Column) -> Column:
    """Whether a literal of that kind can go to a parameter of that type; without a hint, all can."""
    t = F.lower(parameter)
    number = ~t.contains("*") & t.rlike(r"\b(int|long|short|unsigned|size_t|u?int[0-9]+_t|char|bool|float|double)\b")
    return (
        F.when(hint.isNull(), True).when(hint == "string", t.rlike(r"char|string|wchar|tchar")).when(hint == "nullptr", t.contains("*") | t.contains("ptr"))
        .when(hint == "bool", t.contains("bool") | t.rlike(r"\bint\b")).otherwise(number)
    )


def context_of(name: Column) -> Column:
    """isr or task by how a function is called, else null."""
    return F.when(name.rlike(r"(FromISR|_isr|_ISR|_IRQHandler|ISR_Handler|_irq)$"), "isr").when(name.rlike(r"(Task|_task|TaskFunction|_thread)$"), "task")


def api_context(name: Column) -> Column:
    """isr or task by the names that a kernel's API and interrupt handlers have, else null: narrower than ``context_of``."""
    special = name.contains("FromISR") | name.rlike(r"(?:ISR|IRQHandler|SysTickHandler|PendSVHandler|SVCHandler)$")
    return F.when(special, "isr").when(name.rlike(r"^(?:xQueue|vQueue|xTimer|vTimer)|^(?:xTaskCreate|vTaskStartScheduler)$"), "task")
