"""Rules over small collected statistics that decide what the operators compute."""
