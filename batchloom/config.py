"""Settings of a loader and constants with a meaning."""

from __future__ import annotations

from dataclasses import dataclass

IGNORE = -100
MODES = ("sft", "reward_model", "dpo", "rollout")
#: Longest sequence that the binary formats can hold.
MOST_IDS = 65535


@dataclass(frozen=True)
class LoaderConfig:
    max_seq_len: int = 512
    max_prompt_len: int = 256
    max_gen_len: int = 256
    batch_size: int = 8
    boundaries: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048)
    pad_id: int = 0
    eos_id: int = 2
    seed: int = 42
    epoch: int = 0
    world_size: int = 1
    shard_size: int = 10_000
    window_size: int = 4
    shuffle: bool = True
    vocab_size: int = 50_254
    group_size: int = 4
