"""Physical choices shared by the operators: safe broadcasts, hot keys, checkpoints."""
