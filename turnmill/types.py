"""Record shapes and default settings."""

from __future__ import annotations

from dataclasses import dataclass

TURN = "struct<role:string,content:string,speaker:string,token_count:int,parsed_answer:string,finish_reason:string>"
TRAJECTORY = (
    "struct<task_id:int,trajectory_id:int,question:string,answer:string,context_first:array<string>,context_second:array<string>,"
    f"data_type:string,dataset_name:string,score_type:string,system_first:string,system_second:string,turns:array<{TURN}>,"
    "conversation:array<string>,final_answer:string,token_count:int,termination_reason:string,reward:double,correct_score:double,"
    "token_score:double,ppl_score:double,name_penalty:double,selected:boolean,rank:int>"
)
TASK_LINE = f"task_id int, results array<{TRAJECTORY}>"


@dataclass(frozen=True)
class Settings:
    """Defaults of a run."""

    seed: int = 42
    sample_count: int = 100
    explore_count: int = 8
    max_round: int = 10
    max_tokens_per_turn: int = 2000
    epsilon: float = 0.6
    lambda1: float = -0.5
    lambda2: float = 0.6
    trim_low: float = 0.0
    trim_high: float = 0.7
    short_tokens: int = 40
    long_tokens: int = 2000
    name_penalty: float = -10.0
    sft_train_share: float = 0.98
    pair_train_share: float = 0.9
    min_value: float = 0.4
    min_gap: float = 0.2
    top_k: int = 10
    pair_keep_share: float = 0.5
    budget_quantile: float = 0.85
    merge_share: float = 0.10
    select_share: float = 0.25
    consensus: float = 0.9


# Fixed values: (lambda1, lambda2, epsilon) of each task set.
PRESETS = {
    "hotpot_qa": (-0.6, 1.0, 0.5),
    "mwh_qa": (-0.6, 1.0, 0.5),
    "trival_qa": (-0.6, 1.0, 0.5),
    "cbt": (-0.6, 1.0, 0.5),
    "gsm8k": (-0.4, 0.9, 0.6),
    "math": (-0.4, 0.8, 0.6),
    "arc": (-0.5, 0.6, 0.6),
    "mmlu": (-0.6, 0.7, 0.6),
}
