"""kvern.plans"""
