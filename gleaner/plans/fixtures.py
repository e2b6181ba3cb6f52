"""Literal rows for what the generated tables don't hold: headings, bullets, codes,
chips, versions, specifications, CJK text, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHEET = "CPU: NXP i.MX8M Mini\nRAM: 2GB LPDDR4\nFlash: 16GB eMMC\n3 x UART\n2 x I2C\n1 x USB 2.0\nOS: Yocto Linux\nPower Input: DC 12V\nLVDS display"

TEXTS = [
    (-1, "P05D00107-00_manual.pdf", "1. Introduction\nUses STM32F407 with P05D00107-00 and v1.2.3\n- one\n- two\n- three\n\nFeatures\nUSB and Ethernet"),
    (-2, "faq_board.pdf", "HARDWARE OVERVIEW\nRK3568 board, FW v2.10 | Android 11 | upgrade\na | b\nchapter 2: Installation of the board\nGPIO pins 40"),
    (-3, "datasheet.pdf", "支援四個串口以上 i.MX8M 支援四個串口 UART\n記憶體容量與儲存空間說明"),
    (-4, "folder/p12d345 sheet.pdf", SHEET),
    (-5, "board.pdf", "12 mm wide\nMemory\nname  value  unit\nsize  12  mm\nmass  3  kg\n* item\nRTL8111 and RZ/G2L by Renesas, Rockchip or NXP; ST parts\nFirmware 3.4 Yocto 4.0"),
    (-6, "empty.pdf", ""),
    (-7, "broken.pdf", "word-\n wrapped and  spaced\ttext\r\n\r\n\r\n\r\nnext \r line\n2.1 Section title here\nbody\n2.1.1) Deeper title here\nbody of it\n[TABLE 1]"),
]

QUESTIONS = [
    (1, "Which NXP products support LVDS"),
    (2, "請找出 3 個 UART 以上"),
    (3, "少於 3 個 UART"),
    (4, "USB 3.0"),
    (5, "UART 3 個以下"),
    (6, "Which boards can support Yocto?"),
    (7, "I know LVDS"),
    (8, "Renzsas products"),
    (9, "list RK3568 boards with RAM 4GB 以上 and DC 12V power"),
    (10, "how thick is the board"),
]

#: (query_id, ord, field, op, value as text) that plan() must give for QUESTIONS.
CONDITIONS = [
    (1, 1, "has_lvds", "==", "true"),
    (1, 2, "vendor", "contains", "NXP"),
    (2, 1, "uart_count", ">=", "3.0"),
    (3, 1, "uart_count", ">=", "3.0"),
    (4, 1, "usb_count", ">=", "3.0"),
    (5, 1, "uart_count", "<=", "3.0"),
    (6, 1, "os_list", "contains", "Yocto"),
    (6, 2, "can_count", ">=", "1.0"),
    (7, 1, "has_lvds", "==", "false"),
    (8, 1, "vendor", "contains", "Renesas"),
    (9, 1, "ram_gb", ">=", "4.0"),
    (9, 2, "cpu_soc", "contains", "RK3568"),
    (9, 3, "power_input", "contains", "DC 12V"),
]


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id long, source string, text string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


def quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A VALUES table for SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS {name}({columns})"
