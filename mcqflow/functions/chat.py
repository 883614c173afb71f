"""Chat text as string expressions; the template strings are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Strings around each turn. A turn reads ``open + role + body + text + close``.

    With thinking off, ``no_thinking`` precedes the answer both in the
    generation prompt and in the full dialogue, so the prompt stays a string
    prefix of the full text: the label mask counts on that.
    """

    open: str = "<|im_start|>"
    body: str = "\n"
    close: str = "<|im_end|>\n"
    assistant: str = "assistant"
    user: str = "user"
    no_thinking: str = "<think>\n\n</think>\n\n"

    def head(self, role: Column) -> Column:
        """Text before a turn's own content."""
        return F.concat(F.lit(self.open), role, F.lit(self.body))

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(self.head(role), text, F.lit(self.close))

    def answer_head(self, enable_thinking: bool = False) -> str:
        """The generation prefix: what stands before the assistant's answer."""
        thinking = "" if enable_thinking else self.no_thinking
        return f"{self.open}{self.assistant}{self.body}{thinking}"

    def prompt(self, user_text: Column, enable_thinking: bool = False) -> Column:
        """User turn followed by the generation prefix."""
        return F.concat(
            self.turn(F.lit(self.user), user_text), F.lit(self.answer_head(enable_thinking))
        )

    def dialogue(self, user_text: Column, answer: Column, enable_thinking: bool = False) -> Column:
        """User turn and the assistant's complete answer turn."""
        return F.concat(self.prompt(user_text, enable_thinking), answer, F.lit(self.close))

    def messages(self, messages: Column, generation: bool = False, enable_thinking: bool = False) -> Column:
        """Render an ``array<struct<role,content>>`` in array order; ``generation`` ends it with
        the head of the assistant's answer. A null role or content gives null."""
        turns = F.transform(messages, lambda m: self.turn(m["role"], m["content"]))
        text = F.when(~F.exists(turns, lambda t: t.isNull()), F.array_join(turns, ""))
        return F.concat(text, F.lit(self.answer_head(enable_thinking))) if generation else text


CHATML = ChatTemplate()
