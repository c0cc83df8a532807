"""Training scripts as text: supervised, preference and reward training with adapters."""

from __future__ import annotations

# Layers that adapters are put on, and the architectures whose layers have these names.
LAYERS = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")
ARCHITECTURES = ("llama", "mistral", "mixtral", "qwen", "deepseek", "phi", "gemma", "gpt-oss")
TARGETS = dict.fromkeys(ARCHITECTURES, LAYERS)
_TRAINERS = {"sft": ("SFTTrainer", "SFTConfig"), "dpo": ("DPOTrainer", "DPOConfig"), "orpo": ("ORPOTrainer", "ORPOConfig"), "kto": ("KTOTrainer", "KTOConfig"), "grpo": ("GRPOTrainer", "GRPOConfig")}


def targets(model: str) -> tuple[str, ...]:
    """Adapter targets of the architecture that the model's name contains; the most common ones else."""
    return next((t for name, t in TARGETS.items() if name in model.lower()), LAYERS)


def training_script(method: str, model: str, data: str, rank: int = 16, epochs: int = 1) -> str:
    """A script that trains ``model`` on the exported ``data`` by ``method``."""
    if method not in _TRAINERS:
        raise ValueError(f"unknown method: {method}")
    trainer, config = _TRAINERS[method]
    reward = ["", "def reward(completions, rewards=None, **_):", "    return [float(r) for r in rewards]", ""] if method == "grpo" else [""]
    call = f"trainer = {trainer}(model={model!r}, args=args, train_dataset=data, peft_config=adapter{', reward_funcs=[reward]' if method == 'grpo' else ''})"
    lines = ["from datasets import load_dataset", "from peft import LoraConfig", f"from trl import {config}, {trainer}", *reward]
    lines += [f'data = load_dataset("json", data_files={data!r}, split="train")', f"adapter = LoraConfig(r={rank}, lora_alpha={2 * rank}, target_modules={list(targets(model))!r})", f'args = {config}(output_dir="out", num_train_epochs={epochs})', call, "trainer.train()", 'trainer.save_model("out")']
    return "\n".join(lines) + "\n"
