"""Where files, rules, manifests and state come from."""
