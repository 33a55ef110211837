"""Part of the tabloom package."""
