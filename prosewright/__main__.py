from prosewright.plans.verbs import main

main()
