"""Part of the core library; imports nothing from the llm subpackage."""
