"""Reserved: the engine has no streaming operators, as there are none to match."""
