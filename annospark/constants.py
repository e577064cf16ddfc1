"""Fixed values of the annotation text format."""

from __future__ import annotations

# Placeholders, marks and special tokens of the text format.
IMAGE = "<image>"
BOXES, MASKS, POINTS, KEYPOINTS, DEPTH = "<boxes>", "<masks>", "<points>", "<keypoints>", "<depth>"
PHRASE_START, PHRASE_END = "<Phrase>", "</Phrase>"
STAGE1_START, STAGE1_END = "<ph_st>", "<ph_ed>"
TASK_START, TASK_END = "<Task>", "</Task>"
UNIT_START, UNIT_END = "<Unit>", "</Unit>"
REFERENCE = "<REF>"
VISUAL_PROMPT = "[VPT]"
IGNORE, PAD, IMAGE_TOKEN, PROMPT_TOKEN = -100, 0, -200, -300
# Unit and sequence field of each placeholder.
UNIT_OF = {BOXES: "box", MASKS: "mask", POINTS: "point", KEYPOINTS: "keypoint", DEPTH: "depth"}
SEQ_OF = {BOXES: "boxes_seq", MASKS: "masks_seq", POINTS: "points_seq", KEYPOINTS: "keypoints_seq", DEPTH: "depth_seq"}
# Marks of the token types in a sequence.
TOKEN_MASKS = {"ref": 1, "bou": 2, "eou": 3, "bop": 4, "eop": 5, "vis": 6, "vpt": 7}
# Chat templates.
VICUNA = {
    "system": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions. {system}\n ",
    "instruction": "USER: {input} ASSISTANT:",
    "sep": "\n",
}
TASK_COMMAND = {
    "prefix": (
        "A chat between curious user and an artificial intelligence assistant capable of handling common computer vision tasks. "
        "The assistant provides an answer to the user's questions based on a specific task command.\n"
        "Capabilities and tools that assistant can possess:\n"
        "- Sentence: gives helpful, detailed, and polite answers.\n"
        "- Phrase: gives short, precise answers, follow the format of '<Phrase>phrase</Phrase>'.\n"
        "- Unit: gives answers with given unit name, follow the format of '<Unit>unit name</Unit>[number]'.\n"
    ),
    "system": "{system}\n",
    "instruction": "USER: {input} ASSISTANT:",
    "sep": "\n",
}
# The task names of the corpora, what their answers hold, and their unit.
TASKS = {
    "vqa": (("sentence",), None),
    "detection": (("phrase",), "box"),
    "segmentation": (("phrase",), "mask"),
    "grounding_detection": (("phrase",), "box"),
    "grounding_segmentation": (("phrase",), "mask"),
    "gcg_detection": (("phrase", "sentence"), "box"),
    "gcg_segmentation": (("phrase", "sentence"), "mask"),
    "grounding_keypoints": (("phrase",), "keypoint"),
    "referring vqa": (("sentence",), None),
    "depth": ((), "depth"),
}
