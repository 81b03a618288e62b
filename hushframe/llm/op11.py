"""Query of the main text of pages."""

from __future__ import annotations

from hushframe.llm.maintext import main_text
from hushframe.llm.registry import query, table


@query("op11_main_text")
def op11_main_text(spark, folder):
    return main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
