"""Plain config objects shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# The defaults and choices a user of the original tool relies on.
MAX_LENGTH = 2048
MAX_OUTPUT_LENGTH = 512
DEFAULT_EVAL_SIZE = 2000
DEFAULT_EVAL_RATIO = 0.02
MAX_INPUT_LEN = 1536
MAX_OUTPUT_LEN = 512
LABEL_IGNORE = -100
INPUT_FORMATS = ("auto", "messages", "chosen", "sharegpt", "alpaca", "prompt-response")
MULTIMODAL_MODES = ("preserve", "placeholder", "text-only", "strict")
THINKING_MODES = ("auto", "true", "false")
EFFORT_MODES = ("auto", "low", "medium", "high")


def _one_of(name: str, value: str, choices: tuple[str, ...]) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {choices}, got {value!r}")


@dataclass(frozen=True)
class Budget:
    """Token budget of one sample: whole sequence and response part."""

    max_length: int = MAX_LENGTH
    max_output: int = MAX_OUTPUT_LENGTH

    def __post_init__(self) -> None:
        if self.max_output >= self.max_length:
            raise ValueError("max_output must be smaller than max_length")

    @property
    def max_input(self) -> int:
        return self.max_length - self.max_output


@dataclass(frozen=True)
class BatchSpec:
    """Padding lengths and fill values of a training batch."""

    max_input: int = MAX_INPUT_LEN
    max_output: int = MAX_OUTPUT_LEN
    pad_id: int = 0
    batch_size: int = 8

    @property
    def max_length(self) -> int:
        return self.max_input + self.max_output


@dataclass(frozen=True)
class PrepConfig:
    """How to read, normalise, split and expand one chat corpus."""

    input_format: str = "auto"
    messages_column: str | None = None
    chosen_column: str | None = None
    conversations_column: str | None = None
    role_field: str = "role"
    content_field: str = "content"
    sharegpt_role_field: str = "from"
    sharegpt_content_field: str = "value"
    system_column: str | None = None
    instruction_column: str | None = None
    input_column: str | None = None
    output_column: str | None = None
    prompt_column: str | None = None
    response_column: str | None = None
    multimodal_mode: str = "preserve"
    use_processor: bool = False
    preserve_developer: bool = False
    enable_thinking: str = "auto"
    reasoning_effort: str = "auto"
    eval_size: int = DEFAULT_EVAL_SIZE
    eval_ratio: float = DEFAULT_EVAL_RATIO
    seed: int = 42
    on_error: str = "raise"
    budget: Budget = field(default_factory=Budget)

    def __post_init__(self) -> None:
        _one_of("input_format", self.input_format, INPUT_FORMATS)
        _one_of("multimodal_mode", self.multimodal_mode, MULTIMODAL_MODES)
        _one_of("enable_thinking", self.enable_thinking, THINKING_MODES)
        _one_of("reasoning_effort", self.reasoning_effort, EFFORT_MODES)
        _one_of("on_error", self.on_error, ("raise", "quarantine"))
